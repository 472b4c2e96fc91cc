"""Great-circle and local-plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, kilometres per degree and the cosine floor of boxes.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.0
MIN_COS_LAT = 0.15


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def folded(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same point of the sphere with its latitude within the poles; only a latitude beyond a pole is changed."""
    turned = F.pmod(lat + 180.0, F.lit(360.0)) - 180.0
    over = F.abs(turned) > 90.0
    within = F.when(F.abs(lat) <= 90.0, lat).when(over, F.signum(turned) * 180.0 - turned).otherwise(turned)
    return within, F.when((F.abs(lat) > 90.0) & over, lon + 180.0).otherwise(lon)


def initial_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def angular_difference_deg(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def bbox(lat: Column, lon: Column, radius_km: Column) -> Column:
    """Struct (west, south, east, north) around a point."""
    dlat = radius_km / KM_PER_DEGREE
    dlon = radius_km / (F.lit(KM_PER_DEGREE) * F.greatest(F.lit(MIN_COS_LAT), F.cos(F.radians(lat))))
    return F.struct(
        (lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north")
    )


def clip_fractions(x0: Column, y0: Column, x1: Column, y1: Column, box: Column) -> Column:
    """Struct (u0, u1) of the part of a segment inside a box; null where nothing is inside.

    Each edge limits the parameter from below or above; a segment parallel to an edge and outside
    it has no inside part.
    """
    dx, dy = x1 - x0, y1 - y0
    edges = [
        (-dx, x0 - box["west"]), (dx, box["east"] - x0), (-dy, y0 - box["south"]), (dy, box["north"] - y0),
    ]
    flat = [F.abs(p) < 1e-15 for p, _ in edges]
    lows = [F.when(~f & (p < 0), q / p) for f, (p, q) in zip(flat, edges)]
    highs = [F.when(~f & (p > 0), q / p) for f, (p, q) in zip(flat, edges)]
    u0 = F.greatest(F.lit(0.0), *lows)
    u1 = F.least(F.lit(1.0), *highs)
    outside = F.lit(False)
    for f, (_, q) in zip(flat, edges):
        outside = outside | (f & (q < 0))
    return F.when(~outside & (u0 <= u1), F.struct(u0.alias("u0"), u1.alias("u1")))


def clipped_segment_km(x0: Column, y0: Column, x1: Column, y1: Column, box: Column) -> Column:
    """Length of the part of a lon/lat segment inside a box, zero when none is."""
    part = clip_fractions(x0, y0, x1, y1, box)

    def at(u: Column, a: Column, b: Column) -> Column:
        return a + u * (b - a)

    inside = haversine_km(
        at(part["u0"], y0, y1), at(part["u0"], x0, x1), at(part["u1"], y0, y1), at(part["u1"], x0, x1)
    )
    return F.when(part.isNull(), F.lit(0.0)).otherwise(inside)


def polyline_km(coords: Column) -> Column:
    """Length of an array of (lon, lat) points."""
    heads = F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0)))
    tails = F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0)))
    legs = F.zip_with(heads, tails, lambda a, b: haversine_km(F.get(a, 1), F.get(a, 0), F.get(b, 1), F.get(b, 0)))
    return F.aggregate(legs, F.lit(0.0), lambda total, leg: total + F.coalesce(leg, F.lit(0.0)))


def point_to_segment_km(lat: Column, lon: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment on the plane tangent at the point."""
    cos_lat = F.greatest(F.lit(MIN_COS_LAT), F.cos(F.radians(lat)))
    r = F.lit(EARTH_RADIUS_KM)
    ax, ay = F.radians(x0 - lon) * r * cos_lat, F.radians(y0 - lat) * r
    bx, by = F.radians(x1 - lon) * r * cos_lat, F.radians(y1 - lat) * r
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length2))
    return F.when(length2 <= 1e-15, F.hypot(ax, ay)).otherwise(F.hypot(ax + t * dx, ay + t * dy))
