"""Station state, quality and priors on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import DAILY, OBS, OFFSET, daily, observations, offset_hours, six, two
from marketlens.functions.numbers import six as r6
from marketlens.functions.numbers import two as r2
from marketlens.functions.times import naive, settlement_end, settlement_start
from marketlens.operators import priors, rolling, surface
from marketlens.operators.ordered import exact_quantiles
from marketlens.session import cut_lineage

LOOKBACK = 6 * 3600


def joined_text(array):
    return F.array_join(array, ",")


@query("daily_extreme", "C4 D1", f"""WITH {DAILY}
SELECT d.station, d.day, d.high AS extreme, d.n, max(o.valid_time) AS extreme_time, d.official,
 {six('d.official - d.high')} AS residual, abs(d.official - d.high) < 1e-9 AS exact,
 abs(d.official - d.high) <= 1 AS within_one
FROM daily d JOIN obs o ON o.station = d.station AND o.day = d.day AND o.temp = d.high GROUP BY ALL""")
def daily_extreme(spark, d):
    extreme = surface.daily_extreme(observations(spark, d))
    official = daily(spark, d).select("station", "day", "official")
    out = surface.reconstruction_residual(extreme, official, ["station", "day"])
    return out.withColumn("residual", r6(F.col("residual"))).withColumn("extreme_time", naive(F.col("extreme_time")))


@query("extreme_times", "D2", f"""WITH {DAILY}
SELECT o.station, o.day, o.valid_time, d.high, {six('d.high - d.low')} AS day_range
FROM obs o JOIN daily d USING (station, day) WHERE floor(o.temp / 25) = floor(d.high / 25)""")
def extreme_times(spark, d):
    coarse = observations(spark, d).withColumn("temp", F.floor(F.col("temp") / 25))
    ties = surface.extreme_times(coarse)
    out = ties.join(daily(spark, d).select("station", "day", "high", "low"), ["station", "day"])
    return out.select(
        "station", "day", naive(F.col("valid_time")).alias("valid_time"), "high", r6(F.col("high") - F.col("low")).alias("day_range")
    )


@query("basis_summary", "D3", f"""WITH {DAILY}, basis AS (SELECT station, official - high AS b FROM daily)
SELECT station, count(*) AS days, {six('avg(b)')} AS mean, {six('median(b)')} AS median, {six('avg(abs(b))')} AS mean_abs,
 {six('quantile_cont(abs(b), 0.5)')} AS p50, {six('quantile_cont(abs(b), 0.9)')} AS p90,
 {six('quantile_cont(abs(b), 0.95)')} AS p95, count(*) FILTER (round(abs(b), 4) >= 0.1) AS ge_01,
 {six('100.0 * count(*) FILTER (round(abs(b), 4) >= 0.1) / count(*)')} AS ge_01_pct,
 count(*) FILTER (round(abs(b), 4) <= 0.4) AS plausible FROM basis GROUP BY station""")
def basis_summary(spark, d):
    basis = daily(spark, d).select("station", (F.col("official") - F.col("high")).alias("b"))
    basis = basis.withColumn("a", F.abs("b"))
    tidy = F.round("a", 4)
    facts = basis.groupBy("station").agg(
        F.count(F.lit(1)).alias("days"), r6(F.avg("b")).alias("mean"), r6(F.avg("a")).alias("mean_abs"),
        F.count_if(tidy >= 0.1).alias("ge_01"), F.count_if(tidy <= 0.4).alias("plausible"),
    ).withColumn("ge_01_pct", r6(F.col("ge_01") * 100.0 / F.col("days")))
    spread = exact_quantiles(basis, ["station"], "a", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, 0.05)
    middle = exact_quantiles(basis, ["station"], "b", {"median": 0.5}, 0.05)
    out = facts.join(spread, "station").join(middle, "station")
    return out.select("*", *[r6(F.col(c)).alias(f"_{c}") for c in ("p50", "p90", "p95", "median")]).drop(
        "p50", "p90", "p95", "median"
    ).withColumnsRenamed({f"_{c}": c for c in ("p50", "p90", "p95", "median")})


STATE = OBS + f""", st AS (SELECT station, day, seq, valid_time, temp AS latest, count(*) OVER w AS n,
 max(struct_pack(v := temp, t := valid_time)) OVER w AS hi,
 first_value(temp) OVER r AS f, first_value(valid_time) OVER r AS ft
 FROM obs WINDOW w AS (PARTITION BY station, day ORDER BY valid_time ROWS UNBOUNDED PRECEDING),
 r AS (PARTITION BY station, day ORDER BY valid_time RANGE BETWEEN INTERVAL {LOOKBACK} SECOND PRECEDING AND CURRENT ROW)),
state AS (SELECT station, day, seq, valid_time, latest, n, hi.v AS high, hi.t AS last_high_time,
 (epoch_us(valid_time) - epoch_us(hi.t)) / 6e7 AS minutes, hi.v - latest AS fall,
 CASE WHEN valid_time > ft THEN (latest - f) / ((epoch_us(valid_time) - epoch_us(ft)) / 6e7) END AS slope FROM st)"""

REASONS = """concat_ws(',', CASE WHEN minutes IS NULL OR minutes < 60 THEN 'HIGH_NOT_STALE_ENOUGH' END,
 CASE WHEN fall IS NULL OR fall < 1 THEN 'INSUFFICIENT_DROP_FROM_HIGH' END,
 CASE WHEN slope > 0.02 THEN 'TEMPERATURE_STILL_RISING' END)"""


def states(spark, d):
    o = observations(spark, d)
    targets = o.select("station", "day", "seq", F.col("valid_time").alias("at"))
    return surface.causal_state(o, targets, "at", slope_seconds=LOOKBACK)


@query("causal_state", "E4 C1 C4", f"""WITH {STATE}
SELECT station, day, seq, n, high, latest, last_high_time, {two('minutes')} AS minutes_since_high,
 {six('fall')} AS fall, {six('slope')} AS slope FROM state""")
def causal_state(spark, d):
    return states(spark, d).select(
        "station", "day", "seq", "n", "high", "latest", naive(F.col("last_high_time")).alias("last_high_time"),
        r2(F.col("minutes_since_high")).alias("minutes_since_high"), r6(F.col("drop")).alias("fall"),
        r6(F.col("slope")).alias("slope"),
    )


@query("lock_gate", "E5", f"""WITH {STATE} SELECT station, day, seq, {REASONS} AS reasons,
 {REASONS} = '' AS locked,
 (minutes >= 45 AND fall >= 0.75 AND slope IS NOT NULL AND slope <= 0.03) AS live_locked FROM state""")
def lock_gate(spark, d):
    c = {n: F.col(n) for n in ("high", "latest", "minutes_since_high", "drop", "slope")}
    plain = surface.gate_reasons(*c.values())
    live = surface.gate_reasons(*c.values(), min_minutes=45.0, min_drop=0.75, max_slope=0.03, require_slope=True)
    return states(spark, d).select(
        "station", "day", "seq", joined_text(plain).alias("reasons"), (F.size(plain) == 0).alias("locked"),
        (F.size(live) == 0).alias("live_locked"),
    )


FEATURES = DAILY + f""", grid AS (SELECT station, day, official, hour,
 CAST(day AS TIMESTAMP) - to_hours(CAST({OFFSET} AS BIGINT)) + to_hours(hour) AS at
 FROM daily, (SELECT unnest(generate_series(10, 18)) AS hour)),
feat AS (SELECT g.station, g.day, g.hour, g.official, count(o.seq) AS n, max(o.temp) AS high,
 arg_max(o.temp, o.valid_time) AS latest, max(struct_pack(v := o.temp, t := o.valid_time)) AS hi,
 arg_max(o.k, o.valid_time) AS aux, max(o.valid_time) AS lt,
 min(CASE WHEN o.valid_time >= g.at - INTERVAL {LOOKBACK} SECOND THEN struct_pack(t := o.valid_time, v := o.temp) END) AS f
 FROM grid g JOIN obs o ON o.station = g.station AND o.day = g.day AND o.valid_time <= g.at, (SELECT 1)
 GROUP BY g.station, g.day, g.hour, g.official, g.at),
features AS (SELECT f.station, f.day, CAST(f.hour AS INTEGER) AS hour, f.official, f.n, f.high, f.latest, f.aux,
 (epoch_us(g.at) - epoch_us(f.hi.t)) / 6e7 AS minutes, f.high - f.latest AS fall,
 CASE WHEN f.lt > f.f.t THEN (f.latest - f.f.v) / ((epoch_us(f.lt) - epoch_us(f.f.t)) / 6e7) END AS slope,
 f.official - f.high AS residual
 FROM feat f JOIN grid g ON g.station = f.station AND g.day = f.day AND g.hour = f.hour)"""


def feature_rows(spark, d, o=None):
    o = observations(spark, d) if o is None else o
    days = o.groupBy("station", "day").agg(F.floor(F.max("temp") + 0.5).cast("double").alias("official"))
    targets = surface.hourly_targets(
        days, range(10, 19), settlement_start(F.col("day"), offset_hours(F.col("station")))
    )
    out = surface.causal_state(o, targets, "at", extra=["k"], slope_seconds=LOOKBACK).where(F.col("n") > 0)
    return out.withColumn("residual", F.col("official") - F.col("high"))


@query("feature_history", "E6", f"""WITH {FEATURES} SELECT station, day, hour, n, high, latest, aux, official,
 {two('minutes')} AS minutes_since_high, {six('fall')} AS fall, {six('slope')} AS slope, {six('residual')} AS residual
 FROM features""")
def feature_history(spark, d):
    return feature_rows(spark, d).select(
        "station", "day", "hour", "n", "high", "latest", F.col("k").alias("aux"), "official",
        r2(F.col("minutes_since_high")).alias("minutes_since_high"), r6(F.col("drop")).alias("fall"),
        r6(F.col("slope")).alias("slope"), r6(F.col("residual")).alias("residual"),
    )


@query("latest_change_rate", "E7", f"""WITH {OBS}, l AS (SELECT station, count(*) AS n,
 max(struct_pack(t := valid_time, v := temp)) AS m FROM obs GROUP BY station),
f AS (SELECT o.station, min(struct_pack(t := o.valid_time, v := o.temp)) AS m FROM obs o JOIN l USING (station)
 WHERE o.valid_time >= l.m.t - INTERVAL 86400 SECOND GROUP BY o.station)
SELECT station, l.n, l.m.v AS latest, CASE WHEN l.m.t > f.m.t
 THEN {six('(l.m.v - f.m.v) / ((epoch_us(l.m.t) - epoch_us(f.m.t)) / 6e7)')} END AS rate FROM l JOIN f USING (station)""")
def latest_change_rate(spark, d):
    out = surface.latest_change_rate(observations(spark, d), ["station"], "temp", seconds=86_400)
    return out.select("station", "n", "latest", r6(F.col("rate")).alias("rate"))


LIMITS = {
    "min_temp": 0.0, "max_temp": 250.0, "max_jump": 20.0, "gap_warn": 240.0, "gap_fail": 720.0,
    "flat_warn": 60.0, "flat_fail": 240.0, "stale_warn": 120.0, "stale_fail": 600.0,
}


@query("series_quality", "E8", f"""WITH {OBS}, q AS (SELECT station, day, valid_time AS t, floor(temp / 25) * 25 AS v,
 CAST(day AS TIMESTAMP) - to_hours(CAST({OFFSET} AS BIGINT)) + INTERVAL 1 DAY AS as_of FROM obs),
s AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv, last_value(v) OVER (PARTITION BY station, day ORDER BY t
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM q WINDOW w AS (PARTITION BY station, day ORDER BY t)),
g AS (SELECT station, day, count(*) AS n, max(t) AS lt, max(CASE WHEN v <> lv THEN t END) AS ct, any_value(as_of) AS as_of,
 coalesce(max((epoch_us(t) - epoch_us(pt)) / 6e7), 0) AS gap,
 coalesce(max(abs(v - pv) / ((epoch_us(t) - epoch_us(pt)) / 6e7)), 0) AS jump, max(v) > 250 OR min(v) < 0 AS oor
 FROM s GROUP BY station, day),
h AS (SELECT g.*, (epoch_us(lt) - epoch_us((SELECT min(s.t) FROM s WHERE s.station = g.station AND s.day = g.day
 AND (g.ct IS NULL OR s.t > g.ct)))) / 6e7 AS flat, greatest(0, (epoch_us(as_of) - epoch_us(lt)) / 6e7) AS age FROM g),
c AS (SELECT *, concat_ws(',', CASE WHEN oor THEN 'TEMPERATURE_OUT_OF_RANGE' END,
 CASE WHEN gap > 720 THEN 'OBSERVATION_GAP_FAIL' WHEN gap > 240 THEN 'OBSERVATION_GAP_WARN' END,
 CASE WHEN jump > 20 THEN 'IMPLAUSIBLE_TEMPERATURE_JUMP' END,
 CASE WHEN age > 600 THEN 'STALE_STATION_FAIL' WHEN age > 120 THEN 'STALE_STATION_WARN' END,
 CASE WHEN flat >= 240 THEN 'TEMPERATURE_FLATLINE_FAIL' WHEN flat >= 60 THEN 'TEMPERATURE_FLATLINE_WARN' END) AS reasons FROM h)
SELECT station, day, n, reasons, CASE WHEN oor OR jump > 20 OR reasons LIKE '%_FAIL%' THEN 'FAIL' WHEN reasons = '' THEN 'PASS'
 ELSE 'WARN' END AS status, {two('gap')} AS max_gap, {six('jump')} AS max_jump, {two('flat')} AS flat_minutes,
 {two('age')} AS age_minutes FROM c""")
def series_quality(spark, d):
    o = observations(spark, d).withColumn("temp", F.floor(F.col("temp") / 25).cast("double") * 25)
    as_of = o.select("station", "day").distinct().withColumn(
        "as_of", settlement_end(F.col("day"), offset_hours(F.col("station")))
    )
    out = surface.series_quality(o, as_of, limits=LIMITS)
    return out.select(
        "station", "day", "n", joined_text("reasons").alias("reasons"), "status",
        r6(F.col("max_jump")).alias("max_jump"),
        *[r2(F.col(c)).alias(c) for c in ("max_gap", "flat_minutes", "age_minutes")],
    )


CONTRACTS_SQL = """ct AS (SELECT station, day, high, n, shape,
 CASE WHEN shape = 'below' THEN NULL ELSE floor(forecast) END AS lower,
 CASE WHEN shape = 'above' THEN NULL ELSE floor(forecast) + 10 + n END AS upper
 FROM daily, (SELECT unnest(['below', 'bucket', 'above']) AS shape))"""


def contracts(spark, d):
    rows = daily(spark, d).withColumn("shape", F.explode(F.array(*[F.lit(s) for s in ("below", "bucket", "above")])))
    return rows.select(
        "station", "day", "high", "n", "shape",
        F.when(F.col("shape") != "below", F.floor("forecast").cast("double")).alias("lower"),
        F.when(F.col("shape") != "above", F.floor("forecast") + 10.0 + F.col("n")).alias("upper"),
    )


@query("prior_probability", "C5 B9", f"""WITH {DAILY}, {CONTRACTS_SQL}
SELECT c.station, c.day, c.shape, count(h.station) AS prior_n, CASE WHEN count(h.station) >= 5 THEN
 {six('''avg(CASE WHEN h.station IS NULL THEN NULL WHEN c.shape = 'below' THEN (c.high + (h.official - h.high) < c.upper)::INT
 WHEN c.shape = 'above' THEN (c.high + (h.official - h.high) > c.lower)::INT
 ELSE (c.high + (h.official - h.high) BETWEEN c.lower AND c.upper)::INT END)''')} END AS p_yes
FROM ct c LEFT JOIN daily h ON h.station = c.station AND h.day < c.day AND h.n >= 2 GROUP BY c.station, c.day, c.shape""")
def prior_probability(spark, d):
    history = daily(spark, d).withColumn("basis", F.col("official") - F.col("high"))
    out = priors.posterior(
        contracts(spark, d), history, ["station"], "day", value="basis", usable=F.col("n") >= 2, minimum=5
    )
    return out.select("station", "day", "shape", F.col("prior_n").cast("bigint").alias("prior_n"), r6(F.col("p_yes")).alias("p_yes"))


KNN = {"hour": 1.5, "high": 10.0, "minutes_since_high": 60.0, "drop": 1.0, "slope": 0.04}
KNN_SQL = """knn AS (SELECT c.station, c.day, c.hour, h.residual, row_number() OVER (PARTITION BY c.station, c.day, c.hour
 ORDER BY sqrt((power((c.hour - h.hour) / 1.5, 2) + power((c.high - h.high) / 10.0, 2) + power((c.minutes - h.minutes) / 60.0, 2)
 + power((c.fall - h.fall) / 1.0, 2) + coalesce(power((c.slope - h.slope) / 0.04, 2), 0))
 / (4 + (c.slope IS NOT NULL AND h.slope IS NOT NULL)::INT)), h.day, h.hour) AS r
 FROM features c JOIN features h ON h.station = c.station AND h.day < c.day AND abs(h.hour - c.hour) <= 2),
pred AS (SELECT station, day, hour, count(*) AS n, median(residual) AS med, avg((residual <= 0)::INT) AS term,
 list(residual) AS residuals FROM knn WHERE r <= 12 GROUP BY station, day, hour)"""


def knn(spark, d):
    seen = cut_lineage(observations(spark, d))  # read several times
    rows = cut_lineage(feature_rows(spark, d, seen))  # both sides of the join
    return priors.nearest_prior(rows, rows, "station", "day", KNN, tie=["day", "hour"], k=12, minimum=6)


@query("knn_prior", "C6", f"""WITH {FEATURES}, {KNN_SQL}
SELECT f.station, f.day, f.hour, coalesce(p.n, 0) AS neighbours, CASE WHEN p.n >= 6 THEN {six('p.med')} END AS median_residual,
 CASE WHEN p.n >= 6 THEN {six('p.term')} END AS terminal_probability
FROM features f LEFT JOIN pred p USING (station, day, hour)""")
def knn_prior(spark, d):
    return knn(spark, d).select(
        "station", "day", "hour", "neighbours", r6(F.col("median_residual")).alias("median_residual"),
        r6(F.col("terminal_probability")).alias("terminal_probability"),
    )


@query("residual_calibration", "E10", f"""WITH {DAILY}, e AS (SELECT *, official - forecast AS err FROM daily),
c AS (SELECT *, count(*) OVER w AS hn, avg(err) OVER w AS bm, median(err) OVER w AS bd, avg(abs(err)) OVER w AS mae FROM e
 WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT station, day, hn AS history_n, {six('bm')} AS bias_mean, {six('bd')} AS bias_median, {six('mae')} AS mae,
 hn >= 5 AS eligible, CASE WHEN hn >= 5 THEN {six('forecast + bd')} END AS adjusted, {six('err')} AS raw_error,
 CASE WHEN hn >= 5 THEN {six('official - (forecast + bd)')} END AS adjusted_error FROM c""")
def residual_calibration(spark, d):
    out = rolling.residual_calibration(
        daily(spark, d), ["station"], "day", "forecast", "official", lookback=14, minimum=5
    )
    return out.select(
        "station", "day", "history_n", "eligible",
        *[r6(F.col(c)).alias(c) for c in ("bias_mean", "bias_median", "mae", "adjusted", "raw_error", "adjusted_error")],
    )


TOP = """top AS (SELECT station, day, n, official - forecast AS err, CASE WHEN c >= 8 THEN q END AS q90,
 CASE WHEN c >= 8 THEN 100.0 * (len(list_filter(s, lambda x: x < n)) + 0.5 * len(list_filter(s, lambda x: x = n))) / c END AS pct
 FROM (SELECT *, count(*) OVER w AS c, quantile_cont(CAST(n AS DOUBLE), 0.9) OVER w AS q, list(n) OVER w AS s FROM daily
 WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)))"""


def top_decile(spark, d):
    rows = daily(spark, d).withColumn("err", F.col("official") - F.col("forecast"))
    return rolling.rolling_top_decile(rows, ["station"], "day", "n", lookback=20, minimum=8)


@query("rolling_top_decile", "E11", f"""WITH {DAILY}, {TOP} SELECT station, day, {six('q90')} AS q90,
 {six('pct')} AS percentile, coalesce(pct >= 90, false) AS top_decile FROM top""")
def rolling_top_decile(spark, d):
    return top_decile(spark, d).select(
        "station", "day", r6(F.col("q90")).alias("q90"), r6(F.col("percentile")).alias("percentile"), "top_decile"
    )


EFFECT = """hist AS (SELECT station, day, err, (pct >= 90)::INT AS mark FROM top WHERE q90 IS NOT NULL),
dates AS (SELECT DISTINCT day FROM hist),
per AS (SELECT t.day, h.station, count(*) AS n, sum(mark) AS sd, sum(err) AS sy, sum(mark * err) AS sdy
 FROM dates t JOIN hist h ON h.day < t.day GROUP BY 1, 2),
effect AS (SELECT t.day, CASE WHEN sum(sd) >= 2 AND sum(sd - sd * sd / n) > 1e-9
 THEN sum(sdy - sd * sy / n) / sum(sd - sd * sd / n) END AS effect FROM dates t LEFT JOIN per p ON p.day = t.day GROUP BY t.day)"""


def effects(spark, d):
    marked = top_decile(spark, d).where(F.col("q90").isNotNull())
    return rolling.fixed_effect_steps(marked, "station", "day", "top_decile", "err")


@query("fixed_effect_step", "D29", f"WITH {DAILY}, {TOP}, {EFFECT} SELECT day, {six('effect')} AS effect FROM effect")
def fixed_effect_step(spark, d):
    return effects(spark, d).select("day", r6(F.col("effect")).alias("effect"))
