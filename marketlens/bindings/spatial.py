"""Geometry and grids: embedding dimensions read as coordinates, nations as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import EVENTS, OBS, events, observations, six, table
from marketlens.functions import geo, scores
from marketlens.functions.numbers import six as r6
from marketlens.functions.times import naive
from marketlens.operators import spatial


def dim(i):
    return F.get("embedding", F.lit(i)).cast("double")


def points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("point"), (dim(0) * 300).alias("lat"), (dim(1) * 600).alias("lon"),
        (dim(2) * 100 + 30).alias("dbz"), "label", (F.col("vec_id") % 4).alias("frame"),
    )


def places(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("place"), (k * 5.0 - 60).alias("lat"), (k * 14.0 - 170).alias("lon"))


PTS = """pts AS (SELECT vec_id AS point, CAST(embedding[1] AS DOUBLE) * 300 AS lat, CAST(embedding[2] AS DOUBLE) * 600 AS lon,
 CAST(embedding[3] AS DOUBLE) * 100 + 30 AS dbz, label, vec_id % 4 AS frame FROM embeddings),
plc AS (SELECT n_nationkey AS place, n_nationkey * 5.0::DOUBLE - 60 AS lat, n_nationkey * 14.0::DOUBLE - 170 AS lon FROM nation)"""


def km(a, b, c, e):
    return f"""(12742.0176::DOUBLE * asin(least(1, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))
 * pow(sin(radians(({e}) - ({b})) / 2), 2)))))"""


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("great_circle", "B25", f"""WITH {PTS}, x AS (SELECT point, {km('lat', 'lon', '-10', '20')} AS dist, radians(20 - lon) AS dl, radians(lat) AS p1, radians(-10) AS p2, lon FROM pts),
b AS (SELECT *, (degrees(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl))) + 360) % 360 AS bear FROM x)
SELECT point, {six('dist')} AS km, {six('bear')} AS bearing, {six('abs((((bear - lon + 180) % 360) + 360) % 360 - 180)')} AS turn FROM b""")
def great_circle(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    out = points(spark, d).withColumn("km", geo.haversine_km(lat, lon, F.lit(-10.0), F.lit(20.0))).withColumn(
        "bearing", geo.initial_bearing_deg(lat, lon, F.lit(-10.0), F.lit(20.0))
    ).withColumn("turn", geo.angular_difference_deg(F.col("bearing"), lon))
    return tidy(out.select("point", "km", "bearing", "turn"), "km", "bearing", "turn")


@query("bounding_box", "B26", f"""WITH {PTS}, x AS (SELECT *, 150 / 111.0::DOUBLE AS a, 150 / (111.0::DOUBLE * greatest(0.15::DOUBLE, cos(radians(lat)))) AS o FROM pts)
SELECT point, {six('lon - o')} AS west, {six('lat - a')} AS south, {six('lon + o')} AS east, {six('lat + a')} AS north FROM x""")
def bounding_box(spark, d):
    out = points(spark, d).withColumn("_b", geo.bbox(F.col("lat"), F.col("lon"), F.lit(150.0))).select("point", "_b.*")
    return tidy(out, "west", "south", "east", "north")


def lines(spark, d):
    """Three-point lines near ten centres, one per vector."""
    e = table(spark, d, "embeddings")
    lat, lon = F.col("label") * 8.0 - 40, F.col("label") * 20.0 - 90

    def point(i, shift):
        return F.array(lon + dim(i) * 8 + shift, lat + dim(i + 1) * 8)

    return e.select(
        "vec_id", F.col("label").alias("place"), lat.alias("lat"), lon.alias("lon"),
        F.array(point(0, -1.0), point(2, 0.0), point(4, 1.5)).alias("coords"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 420).alias("seen"), (F.col("vec_id") % 3).alias("origin"),
    )


def leg(i, j, s, t):
    return f"""SELECT vec_id, place, lat, lon, seen, origin, {i} AS leg, lon + CAST(embedding[{i}] AS DOUBLE) * 8 + {s} AS x0, lat + CAST(embedding[{i + 1}] AS DOUBLE) * 8 AS y0,
 lon + CAST(embedding[{j}] AS DOUBLE) * 8 + {t} AS x1, lat + CAST(embedding[{j + 1}] AS DOUBLE) * 8 AS y1 FROM ln"""


LEGS = f"""ln AS (SELECT *, label AS place, label * 8.0::DOUBLE - 40 AS lat, label * 20.0::DOUBLE - 90 AS lon,
 TIMESTAMP '2024-01-01' + to_seconds(vec_id * 420) AS seen, vec_id % 3 AS origin FROM embeddings),
legs AS ({leg(1, 3, '-1.0::DOUBLE', '0')} UNION ALL {leg(3, 5, '0', '1.5::DOUBLE')})"""
CLIPPED = f"""box AS (SELECT *, lon - o AS w, lon + o AS e, lat - a AS s, lat + a AS n, x1 - x0 AS dx, y1 - y0 AS dy FROM (SELECT *, 100 / 111.0::DOUBLE AS a,
 100 / (111.0::DOUBLE * greatest(0.15::DOUBLE, cos(radians(lat)))) AS o FROM legs)),
cl AS (SELECT *, greatest(0, least((w - x0) / dx, (e - x0) / dx), least((s - y0) / dy, (n - y0) / dy)) AS u0,
 least(1, greatest((w - x0) / dx, (e - x0) / dx), greatest((s - y0) / dy, (n - y0) / dy)) AS u1 FROM box),
ins AS (SELECT *, CASE WHEN u0 <= u1 THEN {km('y0 + u0 * dy', 'x0 + u0 * dx', 'y0 + u1 * dy', 'x0 + u1 * dx')} ELSE 0 END AS inside, {km('y0', 'x0', 'y1', 'x1')} AS len FROM cl),
pl AS (SELECT *, radians(x0 - lon) * 6371.0088 * cos(radians(lat)) AS ax, radians(y0 - lat) * 6371.0088 AS ay, radians(dx) * 6371.0088 * cos(radians(lat)) AS ux,
 radians(dy) * 6371.0088 AS uy FROM ins),
nr AS (SELECT *, sqrt(pow(ax + t * ux, 2) + pow(ay + t * uy, 2)) AS near FROM (SELECT *, greatest(0, least(1, -(ax * ux + ay * uy) / (ux * ux + uy * uy))) AS t FROM pl))"""


@query("polyline_length", "B27", f"WITH {LEGS} SELECT vec_id, {six('sum(' + km('y0', 'x0', 'y1', 'x1') + ')')} AS km FROM legs GROUP BY vec_id")
def polyline_length(spark, d):
    return lines(spark, d).select("vec_id", r6(geo.polyline_km(F.col("coords"))).alias("km"))


@query("clipped_length", "B28 B29", f"WITH {LEGS}, {CLIPPED} SELECT vec_id, {six('sum(inside)')} AS inside_km, {six('min(near)')} AS nearest_km FROM nr GROUP BY vec_id")
def clipped_length(spark, d):
    out = spatial.line_summary(
        lines(spark, d), ["vec_id"], seen="seen", origin="origin", coords="coords", lat="lat", lon="lon", radius_km=F.lit(100.0)
    )
    return out.select("vec_id", r6(F.col("in_box_km")).alias("inside_km"), r6(F.col("nearest_km")).alias("nearest_km"))


@query("line_summary", "D19", f"""WITH {LEGS}, {CLIPPED}, ll AS (SELECT vec_id, place, seen, origin, sum(len) AS len, sum(inside) AS inside, min(near) AS near FROM nr GROUP BY ALL),
hr AS (SELECT place, date_trunc('hour', seen) AS h, count(*) AS n FROM ll GROUP BY ALL),
pk AS (SELECT place, max(n) AS peak_count, arg_max(h, struct_pack(n := n, t := -epoch(h))) AS peak_hour FROM hr GROUP BY place)
SELECT place, count(*) AS lines, {six('sum(len)')} AS total_km, {six('sum(inside)')} AS in_box_km, {six('max(len)')} AS max_km, {six('min(near)')} AS nearest_km,
 count(DISTINCT seen) AS frames, min(seen) AS first_seen, max(seen) AS last_seen, count(DISTINCT origin) AS origins, any_value(peak_count) AS peak_count,
 any_value(peak_hour) AS peak_hour FROM ll JOIN pk USING (place) GROUP BY place""")
def line_summary(spark, d):
    out = spatial.line_summary(
        lines(spark, d), ["place"], seen="seen", origin="origin", coords="coords", lat="lat", lon="lon", radius_km=F.lit(100.0)
    )
    out = tidy(out, "total_km", "in_box_km", "max_km", "nearest_km")
    return out.withColumns({c: naive(F.col(c)) for c in ("first_seen", "last_seen", "peak_hour")})


@query("lines_by_origin", "D19", f"""WITH {LEGS} SELECT place, CAST(origin AS VARCHAR) AS origin, count(*) AS n FROM ln GROUP BY ALL""")
def lines_by_origin(spark, d):
    return spatial.counts_by_origin(lines(spark, d).withColumn("origin", F.col("origin").cast("string")), ["place"], "origin")


@query("radius_count", "C11", f"""WITH {PTS} SELECT plc.place, count(*) FILTER ({km('plc.lat', 'plc.lon', 'pts.lat', 'pts.lon')} <= 1500) AS n FROM plc, pts GROUP BY plc.place""")
def radius_count(spark, d):
    return spatial.radius_count(places(spark, d), points(spark, d), "place", F.lit(1500.0), cell=5.0)


@query("nearest_point", "C12", f"""WITH {PTS}, x AS (SELECT place, pts.point, pts.dbz, {km('plc.lat', 'plc.lon', 'pts.lat', 'pts.lon')} AS dist FROM plc, pts WHERE pts.dbz >= 35)
SELECT place, {six('min(dist)')} AS distance_km, arg_min(point, dist) AS point, {six('arg_min(dbz, dist)')} AS dbz FROM x GROUP BY place""")
def nearest_point(spark, d):
    out = spatial.nearest_above(places(spark, d), points(spark, d), "place", "dbz", 35.0, tie=["point"])
    return tidy(out.select("place", "distance_km", "point", "dbz"), "distance_km", "dbz")


@query("nearest_cell", "C13", f"""WITH {PTS}, x AS (SELECT place, pts.dbz, pow(pts.lat - plc.lat, 2) + pow(((((pts.lon - plc.lon + 180) % 360) + 360) % 360 - 180)
 * cos(radians(plc.lat)), 2) AS d2 FROM plc, pts) SELECT place, {six('arg_min(dbz, d2)')} AS dbz FROM x GROUP BY place""")
def nearest_cell(spark, d):
    grid = points(spark, d).withColumn("lon", F.pmod("lon", F.lit(360.0)))
    out = spatial.nearest_cell_value(places(spark, d), grid, "place", "dbz", cell=2.0)
    return tidy(out.select("place", "dbz"), "dbz")


@query("region_summary", "D32", f"""WITH {PTS}, g AS (SELECT label, frame, point % 7 AS level, CASE WHEN point % 11 <> 0 THEN dbz END AS v FROM pts)
SELECT label, frame, {six('max(v)')} AS max_value, {six('avg(v)')} AS mean_value, CASE WHEN max(v) > 0 THEN arg_max(level, v) END AS peak_level FROM g GROUP BY label, frame""")
def region_summary(spark, d):
    g = points(spark, d).withColumn("level", F.col("point") % 7).withColumn(
        "v", F.when(F.col("point") % 11 != 0, F.col("dbz")).otherwise(F.lit(float("nan")))
    )
    return tidy(spatial.region_summary(g, ["label", "frame"], "level", "v"), "max_value", "mean_value")


@query("pixel_summary", "B43", f"""WITH {OBS}, p AS (SELECT station, greatest(0, least(1.6::DOUBLE, temp / 100)) AS r, 240 + temp AS k FROM obs),
s AS (SELECT station, count(*) AS pixels, avg(r) AS m, quantile_cont(r, 0.9) AS p90, avg(k) FILTER (k > 150 AND k < 350) AS mk,
 avg((k <= 270)::INT) FILTER (k > 150 AND k < 350) AS cf FROM p GROUP BY station)
SELECT station, pixels, {six('m')} AS mean_reflectance, {six('p90')} AS p90, {six('greatest(0.03::DOUBLE, least(1, 1 - 0.82::DOUBLE * m))')} AS transmission,
 {six('-ln(greatest(0.03::DOUBLE, least(1, 1 - 0.82::DOUBLE * m)))')} AS optical_depth, {six('mk')} AS mean_kelvin, {six('cf')} AS cold_fraction FROM s""")
def pixel_summary(spark, d):
    o = observations(spark, d).withColumns({"r": F.col("temp") / 100, "kelvin": 240 + F.col("temp")})
    out = spatial.reflectance_summary(o, ["station"], "r").join(spatial.brightness_summary(o, ["station"], "kelvin"), "station", "left")
    return tidy(out, "mean_reflectance", "p90", "transmission", "optical_depth", "mean_kelvin", "cold_fraction")


ZONE_HOURS = f"""loc AS (SELECT user_id AS station, CAST(ts - INTERVAL 7 HOUR AS DATE) AS local_date, extract(hour FROM ts - INTERVAL 7 HOUR) AS local_hour, count(*) AS n
 FROM (SELECT DISTINCT user_id, ts, value FROM ev) GROUP BY ALL)"""


def hour_counts(spark, d):
    return spatial.local_hour_counts(events(spark, d), "user_id", "ts", "America/Phoenix", ["ts", "value"])


@query("local_hour_counts", "D20", f"WITH {EVENTS}, {ZONE_HOURS} SELECT station, local_date, local_hour, n FROM loc")
def local_hour_counts(spark, d):
    return hour_counts(spark, d).select(F.col("user_id").alias("station"), "local_date", F.col("local_hour").cast("bigint").alias("local_hour"), "n")


def mid(s, v):
    return f"CASE WHEN len({s}) > 0 THEN 100.0 * (len(list_filter({s}, lambda x: x < {v})) + 0.5 * len(list_filter({s}, lambda x: x = {v}))) / len({s}) END"


@query("hour_percentiles", "E12 I15", f"""WITH {EVENTS}, {ZONE_HOURS}, dy AS (SELECT station, local_date, CAST(coalesce(sum(n) FILTER (local_hour = 13), 0) AS DOUBLE) AS a,
 CAST(coalesce(sum(n) FILTER (local_hour >= 11 AND local_hour < 14), 0) AS DOUBLE) AS b, CAST(coalesce(sum(n) FILTER (local_hour < 14), 0) AS DOUBLE) AS c,
 CAST(coalesce(sum(n) FILTER (local_hour >= 18 AND local_hour < 21), 0) AS DOUBLE) AS e FROM loc GROUP BY ALL),
w AS (SELECT *, list(a) OVER p AS sa, list(b) OVER p AS sb, list(c) OVER p AS sc, list(e) OVER q AS se, lag(e) OVER (PARTITION BY station ORDER BY local_date) AS pe FROM dy
 WINDOW p AS (PARTITION BY station ORDER BY local_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY station ORDER BY local_date ROWS BETWEEN 30 PRECEDING AND 2 PRECEDING))
SELECT station, local_date, a AS last_hour, b AS three_hours, c AS so_far, pe AS prior_evening, {six(mid('sa', 'a'))} AS last_hour_pct, {six(mid('sb', 'b'))} AS three_hours_pct,
 {six(mid('sc', 'c'))} AS so_far_pct, {six(f"CASE WHEN pe IS NOT NULL THEN {mid('se', 'pe')} END")} AS prior_evening_pct, coalesce(len(sa), 0) AS baseline_days FROM w""")
def hour_percentiles(spark, d):
    out = spatial.hour_percentiles(hour_counts(spark, d).withColumnRenamed("user_id", "station"), "station", 14)
    out = out.withColumn("baseline_days", F.col("baseline_days").cast("bigint"))
    return tidy(out, "last_hour_pct", "three_hours_pct", "so_far_pct", "prior_evening_pct")


@query("delta_score", "B23", f"""WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS tr, CASE WHEN k % 7 <> 0 THEN (k * 3 % 100)::DOUBLE END AS cc, value AS ob,
 value + (k % 9) - 4.0::DOUBLE AS md, CASE WHEN k % 3 <> 0 THEN (k - 50) / 200.0::DOUBLE END AS ve, (k % 10) / 15.0::DOUBLE AS cf, CASE WHEN k % 4 <> 0 THEN (k - 40) / 900.0::DOUBLE END AS pv,
 (k % 12) - 4.0::DOUBLE AS hp, value / 10 AS age FROM ev),
p AS (SELECT *, CASE WHEN hp >= 0 THEN greatest(0.35::DOUBLE, least(1, 0.35::DOUBLE + 0.65::DOUBLE * (1 - exp(-hp / 2)))) ELSE greatest(0.1::DOUBLE, least(1, exp(hp / 2))) END AS peak FROM x),
c AS (SELECT *, greatest(-1, least(1, (tr - greatest(0.05::DOUBLE, least(1, 1 - 0.75::DOUBLE * greatest(0, least(1, cc / 100))))) / 0.35::DOUBLE)) * peak AS c1,
 greatest(-1, least(1, ve / 0.2::DOUBLE)) AS c2, greatest(-1, least(1, (ob - md) / 4)) AS c3, -greatest(0, least(1, cf / 0.5::DOUBLE)) * peak AS c4,
 -greatest(-1, least(1, pv / 0.08::DOUBLE)) AS c5 FROM p),
n AS (SELECT *, CASE WHEN tr IS NULL OR cc IS NULL THEN NULL ELSE c1 END AS d1, CASE WHEN ve IS NULL THEN NULL ELSE c2 END AS d2, CASE WHEN pv IS NULL THEN NULL ELSE c5 END AS d5 FROM c),
v AS (SELECT *, greatest(-1, least(1, 0.38::DOUBLE * coalesce(d1, 0) + 0.24::DOUBLE * coalesce(d2, 0) + 0.23::DOUBLE * c3 + 0.10::DOUBLE * c4 + 0.05::DOUBLE * coalesce(d5, 0))) AS value,
 (2 + (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d5 IS NOT NULL)::INT) / 5.0::DOUBLE * exp(-greatest(0, age) / 15) AS conf FROM n)
SELECT event_id, {six('value')} AS value, {six('conf')} AS confidence, CASE WHEN value <= -0.35 THEN 'material_downside_to_model_high' WHEN value >= 0.35 THEN 'material_upside_to_model_high'
 WHEN value < -0.1 THEN 'mild_downside_to_model_high' WHEN value > 0.1 THEN 'mild_upside_to_model_high' ELSE 'near_model_baseline' END AS label FROM v""")
def delta_score(spark, d):
    k, v = F.col("k"), F.col("value")
    s = scores.delta_score(
        F.when(k % 5 != 0, k / 100), F.when(k % 7 != 0, (k * 3 % 100).cast("double")), v, v + (k % 9) - 4.0,
        F.when(k % 3 != 0, (k - 50) / 200), (k % 10) / 15, F.when(k % 4 != 0, (k - 40) / 900), (k % 12) - 4.0, v / 10,
    )
    out = events(spark, d).select("event_id", s.alias("_s"))
    return out.select("event_id", r6(F.col("_s.value")).alias("value"), r6(F.col("_s.confidence")).alias("confidence"), F.col("_s.label").alias("label"))


@query("convective_score", "B24", f"""WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN k % 5 <> 0 THEN value / 3 END AS km, (k * 7 % 360)::DOUBLE AS cb, CASE WHEN k % 6 <> 0 THEN (k * 5 % 360)::DOUBLE END AS wf,
 CASE WHEN k % 4 <> 0 THEN k::DOUBLE END AS dbz, k % 30 AS fl, CASE WHEN k % 3 <> 0 THEN value / 5 END AS mm FROM ev),
t AS (SELECT *, coalesce(abs((((cb - wf + 180) % 360) + 360) % 360 - 180) <= 45, false) AS up FROM x)
SELECT event_id, up AS upwind, {six('''least(1, CASE WHEN km IS NULL THEN 0 ELSE greatest(0, least(0.3::DOUBLE, (20 - km) / 20 * 0.3::DOUBLE)) END
 + CASE WHEN dbz IS NULL THEN 0 ELSE greatest(0, least(0.25::DOUBLE, (dbz - 30) / 30 * 0.25::DOUBLE)) END + CASE WHEN fl > 0 THEN least(0.2::DOUBLE, ln(1 + fl) / ln(21) * 0.2::DOUBLE) ELSE 0 END
 + CASE WHEN mm IS NULL THEN 0 ELSE greatest(0, least(0.15::DOUBLE, mm / 25 * 0.15::DOUBLE)) END + CASE WHEN up THEN 0.1::DOUBLE ELSE 0 END)''')} AS score FROM t""")
def convective_score(spark, d):
    k, v = F.col("k"), F.col("value")
    s = scores.convective_score(
        F.when(k % 5 != 0, v / 3), (k * 7 % 360).cast("double"), F.when(k % 6 != 0, (k * 5 % 360).cast("double")),
        F.when(k % 4 != 0, k.cast("double")), k % 30, F.when(k % 3 != 0, v / 5),
    )
    out = events(spark, d).select("event_id", s.alias("_s"))
    return out.select("event_id", F.col("_s.upwind").alias("upwind"), r6(F.col("_s.score")).alias("score"))
