"""Radius counts, nearest points and line summaries by cells instead of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import geo

#: Degrees per cell of the radius join.
CELL_DEGREES = 1.0

#: Edge lengths of the nested cubic cells on the unit sphere, finest first. Each is four times the
#: one before, more than the 2*sqrt(3) a nearest point can lie beyond the cell that proved one exists.
SPHERE_CELLS = (1 / 64, 1 / 16, 1 / 4, 1.0, 4.0)


def radius_count(
    places: DataFrame, points: DataFrame, place: str, radius_km: Column, *, lat: str = "lat", lon: str = "lon",
    cell: float = CELL_DEGREES,
) -> DataFrame:
    """Points within a radius of each place, zero included.

    Both sides meet on degree cells of the place's box; longitudes wrap and boxes that touch a pole
    take every longitude. A latitude beyond a pole runs down the far meridian. The distance decides, so cells only prune.
    """
    folded_lat, folded_lon = geo.folded(F.col(lat), F.col(lon))
    p = places.withColumns({"_radius": radius_km, "_flat": folded_lat, "_flon": folded_lon})
    half_lat = F.col("_radius") / 110.0
    reach = F.abs(F.col("_flat")) + half_lat
    half_lon = F.when(reach >= 89.0, 180.0).otherwise(
        F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(half_lat)) / F.cos(F.radians(reach))))) + 0.01)
    )
    rows = F.sequence(F.floor((F.col("_flat") - half_lat) / cell), F.floor((F.col("_flat") + half_lat) / cell))
    per_turn = int(round(360 / cell))
    raw = F.sequence(F.floor((F.col("_flon") - half_lon) / cell), F.floor((F.col("_flon") + half_lon) / cell))
    columns = F.array_distinct(F.transform(raw, lambda c: F.pmod(c, F.lit(per_turn))))
    spread = p.select(place, "_radius", F.col(lat).alias("_plat"), F.col(lon).alias("_plon"), F.explode(rows).alias("_r"), columns.alias("_cs"))
    spread = spread.select(place, "_radius", "_plat", "_plon", "_r", F.explode("_cs").alias("_c"))
    usable = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    located = usable.select(
        F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.floor(folded_lat / cell).alias("_r"),
        F.pmod(F.floor(folded_lon / cell), F.lit(per_turn)).alias("_c"),
    )
    hits = located.join(spread, ["_r", "_c"]).where(
        geo.haversine_km(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon")) <= F.col("_radius")
    ).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
    return places.select(place).join(hits, place, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _on_sphere(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    la, lo = F.radians(lat), F.radians(lon)
    return df.withColumns(
        {f"{prefix}x": F.cos(la) * F.cos(lo), f"{prefix}y": F.cos(la) * F.sin(lo), f"{prefix}z": F.sin(la)}
    )


def _cells(prefix: str, edge: float) -> list[Column]:
    return [F.floor(F.col(f"{prefix}{a}") / edge) for a in "xyz"]


_NEIGHBOURS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def nearest_point(
    places: DataFrame, points: DataFrame, place: str, keep: Sequence[str], *, group: Sequence[str] = (),
    lat: str = "lat", lon: str = "lon", tie: Sequence[str] = (),
) -> DataFrame:
    """The nearest point of each place (within equal ``group`` values), with distance and bearing; null if none.

    Points live in nested cubic cells on the unit sphere. Step one finds for each place the finest
    level with any occupied cell among the 27 around it, from the distinct cells alone. A point there
    is at most ``2*sqrt(3)`` edges away, so the 27 cells one level up hold the nearest one.
    """
    group, keep, tie = list(group), list(keep), list(tie)
    p = _on_sphere(places, lat, lon, "_p")
    q = _on_sphere(points, lat, lon, "_q")
    levels = list(enumerate(SPHERE_CELLS))

    def spread(df: DataFrame, prefix: str, wanted: Column | None = None) -> DataFrame:
        options = F.array(
            *[
                F.struct(F.lit(n).alias("_level"), *[c.alias(f"_c{a}") for a, c in zip("xyz", _cells(prefix, edge))])
                for n, edge in levels
            ]
        )
        chosen = options if wanted is None else F.filter(options, lambda o: o["_level"] == wanted)
        return df.withColumn("_o", F.explode(chosen)).select("*", "_o.*").drop("_o")

    around = F.array(*[F.struct(*[F.lit(v).alias(f"_d{a}") for a, v in zip("xyz", n)]) for n in _NEIGHBOURS])

    def widen(df: DataFrame) -> DataFrame:
        out = df.withColumn("_n", F.explode(around))
        return out.withColumns({f"_c{a}": F.col(f"_c{a}") + F.col(f"_n._d{a}") for a in "xyz"}).drop("_n")

    cell = ["_level", "_cx", "_cy", "_cz", *group]
    occupied = spread(q.select(*group, "_qx", "_qy", "_qz"), "_q").select(*cell).distinct()
    finest = widen(spread(p, "_p")).join(occupied, cell).groupBy(place, *group).agg(F.min("_level").alias("_found"))
    searched = F.least(F.col("_found") + 1, F.lit(len(levels) - 1))
    asking = widen(spread(p.join(finest, [place, *group]), "_p", searched))
    candidates = spread(
        q.select(*group, F.col(lat).alias("_qlat"), F.col(lon).alias("_qlon"), "_qx", "_qy", "_qz", *keep), "_q"
    )
    distance = geo.haversine_km(F.col(lat), F.col(lon), F.col("_qlat"), F.col("_qlon"))
    bearing = geo.initial_bearing_deg(F.col(lat), F.col(lon), F.col("_qlat"), F.col("_qlon"))
    met = asking.select(place, lat, lon, *cell).join(candidates, cell).select(
        place, *group, distance.alias("distance_km"), bearing.alias("bearing"), *keep
    )
    best = met.groupBy(place, *group).agg(
        F.min_by(F.struct("distance_km", "bearing", *keep), F.struct("distance_km", *(tie or keep))).alias("_b")
    )
    return places.join(best, [place, *group], "left").select(*places.columns, "_b.*")


def nearest_above(
    places: DataFrame, points: DataFrame, place: str, value: str, threshold: float, *, tie: Sequence[str] = ()
) -> DataFrame:
    """Nearest point whose value reaches a threshold; null where there is none."""
    strong = points.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= threshold))
    return nearest_point(places, strong, place, [value, *[t for t in tie if t != value]], tie=tie)


def nearest_cell_value(
    places: DataFrame, grid: DataFrame, place: str, value: str, *, cell: float = 1.0, tie: Sequence[str] = ()
) -> DataFrame:
    """Value of the grid node nearest in degrees, longitude scaled by the place's cosine.

    Nested degree cells as in :func:`nearest_point`; longitudes of the grid may run 0-360. A place
    takes the first level whose cell is wide enough for its own cosine.
    """
    levels = [cell * 8**n for n in range(4)]
    wrap = lambda c: F.pmod(c + 180.0, F.lit(360.0)) - 180.0
    p = places.withColumn("_plon", wrap(F.col("lon")))
    q = grid.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_qlon", wrap(F.col("lon")))

    def options(lat: str, lon: str) -> Column:
        made = [
            F.struct(F.lit(n).alias("_level"), F.floor(F.col(lat) / e).alias("_r"), F.floor(F.col(lon) / e).alias("_c"))
            for n, e in enumerate(levels)
        ]
        world = F.struct(F.lit(len(levels)).alias("_level"), F.lit(0).cast("bigint").alias("_r"), F.lit(0).cast("bigint").alias("_c"))
        return F.array(*made, world)

    nodes = q.select(F.col("lat").alias("_qlat"), "_qlon", value, *[t for t in tie if t not in (value, "lat", "lon")],
                     F.explode(options("lat", "_qlon")).alias("_o")).select("*", "_o.*").drop("_o")
    occupied = nodes.select("_level", "_r", "_c").distinct()
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    last = len(levels)

    def widen(df: DataFrame) -> DataFrame:
        near = F.when(F.col("_level") == last, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(around)
        out = df.withColumn("_n", F.explode(near))
        turned = out.withColumns({"_r": F.col("_r") + F.col("_n.i"), "_c": F.col("_c") + F.col("_n.j")}).drop("_n")
        return turned

    asked = p.withColumn("_o", F.explode(options("lat", "_plon"))).select(*p.columns, "_o.*")
    found = widen(asked).join(occupied, ["_level", "_r", "_c"]).groupBy(place).agg(F.min("_level").alias("_found"))
    # A node at the found level is within 2*sqrt(2) cells; the searched level must cover that after scaling.
    # Places close to the date line search the whole grid, since cells do not wrap.
    need = F.lit(2.83) * F.element_at(F.array(*[F.lit(e) for e in [*levels, levels[-1] * 8]]), (F.col("_found") + 1).cast("int"))
    fits = F.array(*[
        F.when((F.lit(e) * F.cos(F.radians("lat")) >= need) & (F.abs("_plon") + 2 * e < 180.0), F.lit(n)) for n, e in enumerate(levels)
    ])
    level = F.coalesce(F.get(F.filter(fits, lambda v: v.isNotNull()), F.lit(0)), F.lit(last))
    asking = widen(asked.join(found, place).withColumn("_want", level).where(F.col("_level") == F.col("_want")))
    gap = F.pmod(F.col("_qlon") - F.col("_plon") + 180.0, F.lit(360.0)) - 180.0
    d2 = F.pow(F.col("_qlat") - F.col("lat"), 2) + F.pow(gap * F.cos(F.radians("lat")), 2)
    met = asking.join(nodes, ["_level", "_r", "_c"]).select(place, d2.alias("_d2"), value, *[t for t in tie if t != value])
    best = met.groupBy(place).agg(F.min_by(value, F.struct("_d2", *(tie or [value]))).alias(value))
    return places.join(best, place, "left")


def line_summary(lines: DataFrame, keys: Sequence[str], *, seen: str, origin: str, coords: str, lat: str, lon: str, radius_km: Column) -> DataFrame:
    """Count, length, in-box length, longest, nearest, frames, first/last and peak hour of lines per place."""
    keys = list(keys)
    sized = lines.withColumn("_len", geo.polyline_km(F.col(coords))).withColumn("_box", geo.bbox(F.col(lat), F.col(lon), radius_km))
    heads = F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0)))
    tails = F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0)))

    def over_legs(fn):
        return F.zip_with(heads, tails, lambda a, b: fn(F.get(a, 0), F.get(a, 1), F.get(b, 0), F.get(b, 1)))

    inside = F.aggregate(
        over_legs(lambda x0, y0, x1, y1: geo.clipped_segment_km(x0, y0, x1, y1, F.col("_box"))), F.lit(0.0), lambda t, v: t + v
    )
    near = F.array_min(over_legs(lambda x0, y0, x1, y1: geo.point_to_segment_km(F.col(lat), F.col(lon), x0, y0, x1, y1)))
    measured = sized.withColumns({"_in": inside, "_near": near, "_hour": F.date_trunc("hour", seen)})
    facts = measured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("_len").alias("total_km"), F.sum("_in").alias("in_box_km"),
        F.max("_len").alias("max_km"), F.min("_near").alias("nearest_km"), F.count_distinct(seen).alias("frames"),
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count_distinct(origin).alias("origins"),
    )
    hourly = measured.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    peaks = hourly.groupBy(*keys).agg(
        F.max("_n").alias("peak_count"), F.max_by("_hour", F.struct("_n", -F.unix_seconds("_hour"))).alias("peak_hour")
    )
    return facts.join(peaks, keys)


def counts_by_origin(lines: DataFrame, keys: Sequence[str], origin: str) -> DataFrame:
    return lines.groupBy(*keys, F.coalesce(origin, F.lit("unknown")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def region_summary(grid: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    """Greatest and mean value without NaN, and the level of the greatest value (lowest level on ties)."""
    clean = grid.withColumn("_v", F.when(~F.isnan(value), F.col(value)))
    return clean.groupBy(*keys).agg(
        F.max("_v").alias("max_value"), F.avg("_v").alias("mean_value"),
        F.max_by(level, F.when(F.col("_v").isNotNull(), F.struct("_v", -F.col(level)))).alias("_peak"),
    ).withColumn("peak_level", F.when(F.col("max_value") > 0, F.col("_peak"))).drop("_peak")


def reflectance_summary(pixels: DataFrame, keys: Sequence[str], value: str, width: float = 0.01) -> DataFrame:
    """Mean and 90 % reflectance of clipped pixels, transmission and optical-depth proxy."""
    from marketlens.operators.ordered import exact_quantiles

    clean = pixels.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(
        "_r", F.greatest(F.lit(0.0), F.least(F.lit(1.6), F.col(value)))
    )
    mean = clean.groupBy(*keys).agg(F.avg("_r").alias("mean_reflectance"), F.count(F.lit(1)).alias("pixels"))
    out = mean.join(exact_quantiles(clean, keys, "_r", {"p90": 0.9}, width), list(keys))
    through = F.greatest(F.lit(0.03), F.least(F.lit(1.0), 1.0 - F.lit(0.82) * F.col("mean_reflectance")))
    return out.withColumn("transmission", through).withColumn("optical_depth", -F.log("transmission"))


def brightness_summary(pixels: DataFrame, keys: Sequence[str], value: str, cold: float = 270.0) -> DataFrame:
    """Mean of plausible brightness temperatures and the share at or below the cold threshold."""
    plausible = pixels.where((F.col(value) > 150.0) & (F.col(value) < 350.0))
    return plausible.groupBy(*keys).agg(
        F.avg(value).alias("mean_kelvin"), F.avg((F.col(value) <= cold).cast("double")).alias("cold_fraction")
    )


def local_hour_counts(lines: DataFrame, place: str, seen: str, zone: Column | str, fingerprint: Sequence[str]) -> DataFrame:
    """Detections per place, local date and hour after dropping repeats of the same time and geometry."""
    once = lines.dropDuplicates([place, *fingerprint])
    local = F.from_utc_timestamp(seen, zone)
    return once.groupBy(place, F.to_date(local).alias("local_date"), F.hour(local).alias("local_hour")).agg(
        F.count(F.lit(1)).alias("n")
    )


def hour_percentiles(hours: DataFrame, place: str, completed_hour: int, history_days: int = 30) -> DataFrame:
    """Last full hour, three hours and the day so far of each date against its previous dates.

    ``hours``: place, local_date, local_hour, n. The evening is the previous date's 18-21 h count
    against the dates before it. One row per date stands in the frames.
    """
    from marketlens.operators.rolling import mid_rank

    h = F.col("local_hour")

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")

    days = hours.groupBy(place, "local_date").agg(
        part(h == completed_hour - 1).alias("last_hour"),
        part((h >= max(0, completed_hour - 3)) & (h < completed_hour)).alias("three_hours"),
        part(h < completed_hour).alias("so_far"), part((h >= 18) & (h < 21)).alias("evening"),
    )
    w = Window.partitionBy(place).orderBy("local_date")
    prior, before = w.rowsBetween(-history_days, -1), w.rowsBetween(-history_days, -2)
    seen = days.select(
        "*", *[F.collect_list(c).over(prior).alias(f"_{c}") for c in ("last_hour", "three_hours", "so_far")],
        F.collect_list("evening").over(before).alias("_evening"), F.lag("evening").over(w).alias("prior_evening"),
    )
    return seen.select(
        place, "local_date", "last_hour", "three_hours", "so_far", "prior_evening",
        *[mid_rank(F.col(f"_{c}"), F.col(c)).alias(f"{c}_pct") for c in ("last_hour", "three_hours", "so_far")],
        F.when(F.col("prior_evening").isNotNull(), mid_rank(F.col("_evening"), F.col("prior_evening"))).alias("prior_evening_pct"),
        F.size("_so_far").alias("baseline_days"),
    )
