"""Signal rules on quote snapshots made from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.surface import FEATURES, KNN_SQL, knn
from marketlens.bindings.views import DAILY, QUOTES, daily, quotes, six
from marketlens.functions.contracts import contains, strike_of_shape
from marketlens.functions.numbers import six as r6
from marketlens.operators import rolling
from marketlens.operators import selection as sel
from marketlens.operators import signals as sg


def snapshots(spark, d):
    """Quotes with bounds, a fair value, an outcome and surface features; some asks are missing."""
    q = quotes(spark, d)
    k, v, kind = F.col("k"), F.col("value"), F.col("event_type")
    shape = F.when(k % 3 == 0, "below").when(k % 3 == 1, "bucket").otherwise("above")
    base = F.floor(v / 10).cast("double") * 10
    s = q.select(
        "contract", "seq", "ts", F.to_date("ts").alias("day"), kind, k, v, "yes_bid",
        F.when(~((kind == "error") & (k % 4 == 0)), F.col("yes_ask")).alias("yes_ask"),
        F.when(~((kind == "view") & (k % 4 == 1)), F.col("no_ask")).alias("no_ask"), shape.alias("shape"),
        F.when(shape != "below", base).alias("lower"), F.when(shape != "above", base + 10).alias("upper"),
        k.cast("double").alias("high"), F.round(v / (v + 50), 4).alias("fair_yes"), kind.isin("purchase", "click").alias("resolved_yes"),
        (k * 1.5).alias("minutes_since_high"), F.round(v / 30 - 0.5, 3).alias("drop"),
        F.when(k % 10 != 3, F.round((k - 80) / 1000, 4)).alias("slope"),
    )
    return s.withColumn("in_bucket", contains(F.col("shape"), F.col("lower"), F.col("upper"), F.col("high"), on_bad="false"))


SNAP = QUOTES + """, snap0 AS (SELECT contract, seq, ts, CAST(ts AS DATE) AS day, event_type, k, value, yes_bid,
 CASE WHEN NOT (event_type = 'error' AND k % 4 = 0) THEN yes_ask END AS yes_ask,
 CASE WHEN NOT (event_type = 'view' AND k % 4 = 1) THEN no_ask END AS no_ask,
 CASE WHEN k % 3 = 0 THEN 'below' WHEN k % 3 = 1 THEN 'bucket' ELSE 'above' END AS shape, floor(value / 10) * 10 AS base, k AS high,
 round(value / (value + 50), 4) AS fair_yes, event_type IN ('purchase', 'click') AS resolved_yes, k * 1.5::DOUBLE AS minutes_since_high,
 round(value / 30 - 0.5::DOUBLE, 3) AS fall, CASE WHEN k % 10 <> 3 THEN round((k - 80) / 1000, 4) END AS slope FROM quotes),
snap AS (SELECT *, CASE shape WHEN 'below' THEN high < upper WHEN 'above' THEN high > lower ELSE high BETWEEN lower AND upper END AS in_bucket
 FROM (SELECT *, CASE WHEN shape <> 'below' THEN base END AS lower, CASE WHEN shape <> 'above' THEN base + 10 END AS upper FROM snap0))"""


def fee_sql(price: str) -> str:
    return f"""(CAST(ceil(0.07::DECIMAL(5,4) * ({price})::DECIMAL(9,6) * (1::DECIMAL(1,0) - ({price})::DECIMAL(9,6))
 * 100::DECIMAL(3,0)) AS DOUBLE) / 100)"""


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("tournament_trades", "H1 H2 H3", f"""WITH {SNAP}, c AS (SELECT *, yes_ask + 0.01::DOUBLE + 0.002::DOUBLE AS y, no_ask + 0.01::DOUBLE + 0.002::DOUBLE AS n FROM snap),
t AS (SELECT seq, 'blind_no' AS strategy, 'NO' AS side, n AS price, CAST(NULL AS DOUBLE) AS fair, NOT resolved_yes AS won FROM c WHERE n BETWEEN 0.85 AND 0.99
 UNION ALL SELECT seq, 'model_no', 'NO', n, 1 - fair_yes, NOT resolved_yes FROM c WHERE (1 - fair_yes) - n >= 0.02
 UNION ALL SELECT seq, 'best_yes', 'YES', y, fair_yes, resolved_yes FROM c WHERE fair_yes - y >= 0.02
 UNION ALL SELECT seq, 'late_elimination_no', 'NO', n, 1, NOT resolved_yes FROM c WHERE high > upper AND 1 - n >= 0.005)
SELECT seq, strategy, side, {six('price')} AS entry_price, {six('fair')} AS fair_probability, won, {six('won::INT - price')} AS pnl FROM t""")
def tournament_trades(spark, d):
    s = snapshots(spark, d).withColumns(
        {"fees_per_share": F.lit(0.01), "slippage_per_share": F.lit(0.002), "observed_high": F.col("high")}
    )
    out = sg.tournament_trades(s).select("seq", "strategy", "side", "entry_price", "fair_probability", "won", "pnl")
    return tidy(out, "entry_price", "fair_probability", "pnl")


@query("best_side", "F4 B18", f"""WITH {SNAP}, e AS (SELECT seq, fair_yes - yes_ask AS y, (1 - fair_yes) - no_ask AS n, yes_ask, no_ask FROM snap)
SELECT seq, CASE WHEN y IS NOT NULL AND (n IS NULL OR y >= n) THEN 'YES' WHEN n IS NOT NULL THEN 'NO' END AS side,
 {six('CASE WHEN y IS NOT NULL AND (n IS NULL OR y >= n) THEN y ELSE n END')} AS edge FROM e""")
def best_side(spark, d):
    b = sel.best_side(F.col("fair_yes"), F.col("yes_ask"), F.col("no_ask"))
    return snapshots(spark, d).select("seq", b["side"].alias("side"), r6(b["edge"]).alias("edge"))


@query("simple_signal", "H4", f"""WITH {SNAP}, e AS (SELECT seq, fair_yes - yes_ask AS y, (1 - fair_yes) - no_ask AS n, value,
 greatest(0, yes_ask - yes_bid) AS spread FROM snap WHERE yes_ask IS NOT NULL AND no_ask IS NOT NULL)
SELECT seq, CASE WHEN y >= n THEN 'YES' ELSE 'NO' END AS side, {six('greatest(y, n)')} AS edge FROM e
WHERE value >= 10 AND spread <= 0.12 AND greatest(y, n) >= 0.06""")
def simple_signal(spark, d):
    c = F.col
    out = sg.simple_signal(snapshots(spark, d), c("fair_yes"), c("value"), c("yes_bid"), c("yes_ask"), c("no_ask"))
    return tidy(out.select("seq", "side", "edge"), "edge")


CDF = """(0.5::DOUBLE * (1 + CASE WHEN ({z}) < 0 THEN -1 ELSE 1 END * (1 - (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (0.254829592::DOUBLE
 + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (-0.284496736::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (1.421413741::DOUBLE
 + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (-1.453152027::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * 1.061405429::DOUBLE))))
 * exp(-abs({z}) * abs({z})))))"""


def cdf_sql(x: str, mean: str, sd: str, floor: float) -> str:
    return CDF.format(z=f"(({x}) - ({mean})) / (greatest({floor}::DOUBLE, {sd}) * sqrt(2::DOUBLE))")


STRIKE_P = f"""greatest(0, least(1, CASE shape WHEN 'bucket' THEN {cdf_sql('upper + 0.5', 'mean', 'sd', 0.75)} - {cdf_sql('lower - 0.5', 'mean', 'sd', 0.75)}
 WHEN 'below' THEN {cdf_sql('upper - 0.5', 'mean', 'sd', 0.75)} ELSE 1 - {cdf_sql('lower + 0.5', 'mean', 'sd', 0.75)} END))"""


def evaluation_columns(df):
    return df.select("seq", "reason", "eligible", "side", r6(F.col("edge")).alias("edge"))


EVALUATE = """ev2 AS (SELECT *, CASE WHEN ye IS NOT NULL AND (ne IS NULL OR ye >= ne) THEN 'YES' WHEN ne IS NOT NULL THEN 'NO' END AS side0,
 CASE WHEN ye IS NOT NULL AND (ne IS NULL OR ye >= ne) THEN ye ELSE ne END AS edge0 FROM (SELECT *, p - yes_ask AS ye, (1 - p) - no_ask AS ne FROM pr)),
res AS (SELECT seq, coalesce(refusal, CASE WHEN side0 IS NULL THEN 'NO_EXECUTABLE_ASK' WHEN edge0 < 0.05 THEN 'EDGE_BELOW_MINIMUM' END, 'ELIGIBLE') AS reason,
 CASE WHEN refusal IS NULL THEN side0 END AS side, CASE WHEN refusal IS NULL THEN edge0 END AS edge FROM ev2)"""
RESULT = f"SELECT seq, reason, reason = 'ELIGIBLE' AS eligible, side, {six('edge')} AS edge FROM res"


@query("gaussian_bucket_rule", "H5 B20", f"""WITH {SNAP}, m AS (SELECT *, k + fair_yes AS mean, 1 + value / 40 AS sd,
 CASE WHEN floor(k / 2) < 10 THEN 'INSUFFICIENT_PRIOR_HISTORY:' || CAST(CAST(floor(k / 2) AS BIGINT) AS VARCHAR) || '<10' END AS refusal FROM snap),
pr AS (SELECT *, {STRIKE_P} AS p FROM m), {EVALUATE} {RESULT}""")
def gaussian_bucket_rule(spark, d):
    c = F.col
    out = sg.gaussian_bucket_rule(
        snapshots(spark, d), c("high"), 1 + c("value") / 40, strike_of_shape(c("shape")), c("lower"), c("upper"), c("yes_ask"), c("no_ask"),
        bias=c("fair_yes"), history_n=F.floor(c("k") / 2), min_history=10,
    )
    return evaluation_columns(out)


SAMPLES = """smp AS (SELECT station, day, list(official - forecast) OVER (PARTITION BY station ORDER BY day
 RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS s FROM daily)"""
SHARE = """len(list_filter(s, lambda r: CASE shape WHEN 'below' THEN high + r < upper WHEN 'above' THEN high + r > lower
 ELSE high + r >= lower AND high + r <= upper END)) / len(s)"""


def with_samples(spark, d):
    cal = rolling.residual_calibration(daily(spark, d), ["station"], "day", "forecast", "official", lookback=14, minimum=5)
    return snapshots(spark, d).join(
        cal.select(F.col("station").alias("contract"), "day", "samples"), ["contract", "day"], "left"
    )


@query("empirical_residual_rule", "H6", f"""WITH {SNAP}, {DAILY.replace('ev AS', 'ev_ AS').replace('FROM ev)', 'FROM ev_)')}, {SAMPLES},
pr AS (SELECT snap.*, {SHARE} AS p, CASE WHEN coalesce(len(s), 0) < 5
 THEN 'INSUFFICIENT_PRIOR_HISTORY:' || CAST(coalesce(len(s), 0) AS VARCHAR) || '<5' END AS refusal
 FROM snap LEFT JOIN smp ON smp.station = snap.contract AND smp.day = snap.day), {EVALUATE} {RESULT}""")
def empirical_residual_rule(spark, d):
    c = F.col
    out = sg.empirical_rule(
        with_samples(spark, d), c("high"), c("samples"), c("shape"), c("lower"), c("upper"), c("yes_ask"), c("no_ask"), min_history=5
    )
    return evaluation_columns(out)


@query("remaining_heating_rule", "H7", f"""WITH {FEATURES}, {KNN_SQL}, ct AS (SELECT f.*, p.residuals AS s, 'bucket' AS shape, floor(f.latest) AS lower,
 floor(f.latest) + 20 AS upper, f.station * 1000000 + CAST(strftime(f.day, '%m%d') AS BIGINT) * 100 + f.hour AS seq,
 0.4::DOUBLE AS yes_ask, 0.55::DOUBLE AS no_ask, CASE WHEN f.station % 5 = 0 THEN 'WEATHER_COMPANY' ELSE 'NWS_CLI' END AS family
 FROM features f LEFT JOIN pred p USING (station, day, hour)),
pr AS (SELECT *, {SHARE} AS p, CASE WHEN family <> 'NWS_CLI' THEN 'INCOMPATIBLE_SETTLEMENT_SOURCE:' || family WHEN coalesce(len(s), 0) < 6
 THEN 'INSUFFICIENT_PRIOR_HISTORY:' || CAST(coalesce(len(s), 0) AS VARCHAR) || '<6' END AS refusal FROM ct), {EVALUATE} {RESULT}""")
def remaining_heating_rule(spark, d):
    rows = knn(spark, d)
    c = F.col
    family = F.when(c("station") % 5 == 0, "WEATHER_COMPANY").otherwise("NWS_CLI")
    low = F.floor(c("latest")).cast("double")
    stamp = c("station") * 1000000 + F.date_format("day", "MMdd").cast("bigint") * 100 + c("hour")
    out = sg.empirical_rule(
        rows.withColumn("seq", stamp), c("high"), c("residuals"), F.lit("bucket"), low, low + 20, F.lit(0.4), F.lit(0.55), min_history=6, source_family=family
    )
    return evaluation_columns(out)


@query("eliminated_bucket_rule", "H8", f"""WITH {SNAP}, e AS (SELECT *, CASE shape WHEN 'bucket' THEN high > upper WHEN 'below' THEN high >= upper ELSE false END AS gone,
 1 - no_ask AS edge0 FROM snap)
SELECT seq, CASE WHEN k % 7 = 0 THEN 'UNVERIFIED_SETTLEMENT_SEMANTICS' WHEN NOT gone THEN 'NOT_ELIMINATED' WHEN no_ask IS NULL THEN 'NO_EXECUTABLE_NO_ASK'
 WHEN edge0 < 0.02 OR no_ask > 0.98 THEN 'EDGE_OR_PRICE_GATE' ELSE 'ELIGIBLE' END AS reason, CASE WHEN gone THEN {six('edge0')} END AS edge FROM e""")
def eliminated_bucket_rule(spark, d):
    c = F.col
    e = sg.eliminated_rule(c("high"), strike_of_shape(c("shape")), c("lower"), c("upper"), c("no_ask"), c("k") % 7 != 0)
    out = snapshots(spark, d).withColumn("_e", e)
    return out.select("seq", F.col("_e.reason").alias("reason"), r6(F.col("_e.edge")).alias("edge"))


BEST_NET = f"""net0 AS (SELECT *, p - yes_ask AS gy, p - yes_ask - {fee_sql('yes_ask')} AS ny, (1 - p) - no_ask AS gn,
 (1 - p) - no_ask - {fee_sql('no_ask')} AS nn FROM prob WHERE yes_ask IS NOT NULL OR no_ask IS NOT NULL),
net1 AS (SELECT *, yes_ask IS NOT NULL AND (no_ask IS NULL OR round(ny, 9) >= round(nn, 9)) AS y FROM net0),
net2 AS (SELECT *, CASE WHEN y THEN 'YES' ELSE 'NO' END AS side, CASE WHEN y THEN yes_ask ELSE no_ask END AS ask,
 CASE WHEN y THEN gy ELSE gn END AS gross, CASE WHEN y THEN ny ELSE nn END AS net FROM net1)"""
HEURISTIC = """greatest(0.5::DOUBLE, least(0.94::DOUBLE, 0.84::DOUBLE + coalesce(greatest(0, least(0.06::DOUBLE, (fall - 1) * 0.02::DOUBLE)), 0)
 + CASE WHEN slope < 0 THEN least(0.04::DOUBLE, -slope * 2) ELSE 0 END))"""
TRACK_SQL = f"""trk(track, m, dr, sl, flo, mine) AS (VALUES ('A_CONTROL', 60::DOUBLE, 1::DOUBLE, 0.02::DOUBLE, 0.15::DOUBLE, 0.08::DOUBLE),
 ('B_MODERATE', 45::DOUBLE, 0.75::DOUBLE, 0.03::DOUBLE, 0.15::DOUBLE, 0.06::DOUBLE), ('C_EXPLORATORY', 30::DOUBLE, 0.5::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.04::DOUBLE)),
lk AS (SELECT s.*, t.*, coalesce(minutes_since_high >= m AND fall >= dr AND slope <= sl, false) AS locked FROM snap s, trk t),
prob AS (SELECT *, CASE WHEN NOT locked THEN 0.5::DOUBLE WHEN in_bucket THEN {HEURISTIC} ELSE 1 - {HEURISTIC} END AS p FROM lk), {BEST_NET},
dec AS (SELECT *, CASE WHEN NOT locked THEN 'LOCK_GATE_FAIL' WHEN ask < flo THEN 'PRICE_BELOW_FLOOR' WHEN round(gross, 9) < mine THEN 'EDGE_BELOW_MINIMUM'
 WHEN round(net, 9) <= 0 THEN 'NEGATIVE_AFTER_FEE' ELSE 'PAPER_TRADE_ELIGIBLE' END AS decision FROM net2)"""


@query("track_decisions", "B22 B15 H10", f"""WITH {SNAP}, {TRACK_SQL} SELECT seq, track, locked, {six('p')} AS p_yes, side, {six('gross')} AS gross,
 {six('net')} AS net, decision FROM dec""")
def track_decisions(spark, d):
    out = sg.track_decisions(snapshots(spark, d)).select("seq", "track", "locked", "p_yes", "side", "gross", "net", "decision")
    return tidy(out, "p_yes", "gross", "net")


@query("track_tournament", "H10 F3", f"""WITH {SNAP}, {TRACK_SQL} SELECT contract, day, track, seq, side, {six('net')} AS net, decision FROM dec
QUALIFY row_number() OVER (PARTITION BY contract, day, track ORDER BY round(net, 9) DESC, seq) = 1""")
def track_tournament(spark, d):
    out = sg.track_tournament(snapshots(spark, d), ["contract", "day"], ["seq"])
    return tidy(out.select("contract", "day", "track", "seq", "side", "net", "decision"), "net")


@query("diagnostic_track", "H11", f"""WITH {SNAP}, prob AS (SELECT *, CASE WHEN in_bucket THEN {HEURISTIC} ELSE 1 - {HEURISTIC} END AS p,
 concat_ws(',', CASE WHEN minutes_since_high < 60 THEN 'LOCK_FAIL_TIME' END, CASE WHEN fall < 1 THEN 'LOCK_FAIL_DROP' END,
 CASE WHEN slope IS NULL THEN 'LOCK_FAIL_SLOPE_MISSING' WHEN slope > 0.02 THEN 'LOCK_FAIL_POSITIVE_SLOPE' END) AS failures FROM snap), {BEST_NET}
SELECT seq, failures, failures = '' AS would_pass, {six('minutes_since_high - 60')} AS minutes_margin, {six('fall - 1')} AS drop_margin,
 {six('0.02::DOUBLE - slope')} AS slope_margin, side, {six('net')} AS net, (failures NOT LIKE '%,%' AND round(net, 9) > 0) AS near_signal,
 CASE WHEN failures LIKE '%_MISSING%' THEN 'DATA_INCOMPLETE' WHEN ask < 0.15 THEN 'PRICE_BELOW_FLOOR' WHEN round(gross, 9) < 0.04 THEN 'EDGE_BELOW_MINIMUM'
 WHEN round(net, 9) <= 0 THEN 'NEGATIVE_AFTER_FEE' ELSE 'DIAGNOSTIC_PAPER_ELIGIBLE' END AS decision FROM net2""")
def diagnostic_track(spark, d):
    out = sg.diagnostic_decisions(snapshots(spark, d))
    out = out.select(
        "seq", F.array_join("failures", ",").alias("failures"), "would_pass", "minutes_margin", "drop_margin", "slope_margin",
        "side", "net", "near_signal", "decision",
    )
    return tidy(out, "minutes_margin", "drop_margin", "slope_margin", "net")


@query("monotonic_lock", "H13", f"""WITH {SNAP}, s AS (SELECT *, CASE WHEN shape IN ('bucket', 'below') AND high >= upper + 2 THEN 'NO'
 WHEN shape = 'above' AND high >= lower + 2 THEN 'YES' END AS side FROM snap), a AS (SELECT *, CASE side WHEN 'YES' THEN yes_ask WHEN 'NO' THEN no_ask END AS ask FROM s)
SELECT seq, side, {six('ask')} AS ask, {six(f"1 - ask - {fee_sql('ask')}")} AS gap FROM a WHERE ask <= 0.97 AND round(1 - ask - {fee_sql('ask')}, 9) >= 0.02""")
def monotonic_lock(spark, d):
    c = F.col
    out = sg.monotonic_lock(snapshots(spark, d), c("shape"), c("lower"), c("upper"), c("high"), c("yes_ask"), c("no_ask"))
    return tidy(out.select("seq", "side", "ask", "gap"), "ask", "gap")


def decided(spark, d):
    """Heuristic probability and best side per snapshot, with traded, pending and age flags."""
    from marketlens.functions.probability import provisional_probability

    c = F.col
    locked = F.coalesce((c("minutes_since_high") >= 60) & (c("drop") >= 1) & (c("slope") <= 0.02), F.lit(False))
    s = snapshots(spark, d).withColumn("locked", locked)
    p = provisional_probability(c("in_bucket"), c("locked"), c("drop"), c("slope"))
    priced = sg.with_fees(s, c("yes_ask"), c("no_ask")).withColumn("_p", p)
    s = sg.with_net_best_side(priced, c("_p"), c("yes_ask"), c("no_ask"))
    return s.withColumns(
        {"traded": c("k") % 17 == 0, "pending": c("k") % 13 == 0, "age": F.when(c("k") % 11 != 0, c("value"))}
    )


DECIDED = f"""lk AS (SELECT *, coalesce(minutes_since_high >= 60 AND fall >= 1 AND slope <= 0.02, false) AS locked FROM snap),
prob AS (SELECT *, CASE WHEN NOT locked THEN 0.5::DOUBLE WHEN in_bucket THEN {HEURISTIC} ELSE 1 - {HEURISTIC} END AS p FROM lk), {BEST_NET},
dd AS (SELECT *, k % 17 = 0 AS traded, k % 13 = 0 AS pending, CASE WHEN k % 11 <> 0 THEN value END AS age FROM net2)"""


@query("live_decision", "H15", f"""WITH {SNAP}, {DECIDED} SELECT seq, CASE WHEN traded THEN 'ALREADY_TRADED_EVENT' WHEN pending THEN 'PENDING_DELAYED_FILL'
 WHEN age IS NULL THEN 'NO_LIVE_OBSERVATION' WHEN age > 100 THEN 'STALE_OBSERVATION' WHEN NOT locked THEN 'LOCK_GATE_FAIL' WHEN ask < 0.15 THEN 'PRICE_BELOW_FLOOR'
 WHEN round(gross, 9) < 0.08 THEN 'EDGE_BELOW_MINIMUM' WHEN round(net, 9) <= 0 THEN 'NEGATIVE_AFTER_FEE' ELSE 'PAPER_TRADE_ELIGIBLE' END AS decision FROM dd""")
def live_decision(spark, d):
    s = decided(spark, d)
    dec = sg.live_decision(
        F.col("traded"), F.col("pending"), F.col("age"), F.col("locked"), F.col("ask"), F.col("gross"), F.col("net"),
        floor=0.15, min_edge=0.08,
    )
    return s.select("seq", dec.alias("decision"))


@query("forward_status", "D26", f"""WITH {SNAP}, {DECIDED}, st AS (SELECT s.day, CASE WHEN s.k % 17 = 0 THEN 'ALREADY_TRADED_EVENT' WHEN s.k % 13 = 0 THEN 'PENDING_DELAYED_FILL'
 WHEN NOT s.locked THEN 'LOCK_GATE_FAIL' WHEN dd.ask IS NULL THEN 'NO_EXECUTABLE_QUOTE' WHEN ask < 0.15 THEN 'PRICE_BELOW_FLOOR' WHEN round(gross, 9) < 0.08 THEN 'EDGE_BELOW_MINIMUM'
 WHEN round(net, 9) <= 0 THEN 'NEGATIVE_AFTER_FEE' ELSE 'PAPER_TRADE_ELIGIBLE' END AS decision, net FROM lk s LEFT JOIN dd USING (seq))
SELECT decision, count(*) AS contracts, count(DISTINCT day) AS days, {six('max(net)')} AS best_net FROM st GROUP BY decision""")
def forward_status(spark, d):
    dec = sg.forward_status(
        F.col("traded"), F.col("pending"), F.col("locked"), F.col("ask"), F.col("gross"), F.col("net"), floor=0.15, min_edge=0.08
    )
    out = decided(spark, d).withColumn("decision", dec).groupBy("decision").agg(
        F.count(F.lit(1)).alias("contracts"), F.count_distinct("day").alias("days"), F.max("net").alias("best_net")
    )
    return tidy(out, "best_net")


@query("near_misses", "F8", f"""WITH {SNAP}, {DECIDED} SELECT seq, contract, side, {six('net')} AS net FROM dd
WHERE NOT locked AND round(net, 9) > 0 ORDER BY round(net, 9) DESC, seq LIMIT 25""")
def near_misses(spark, d):
    s = decided(spark, d).where(~F.col("locked") & (F.round("net", 9) > 0))
    top = s.withColumn("_n", F.round("net", 9)).orderBy(F.desc("_n"), "seq").limit(25)
    return top.select("seq", "contract", F.col("side").alias("side"), r6(F.col("net")).alias("net"))


@query("first_qualifying_hour", "F2", f"""WITH {SNAP}, {DECIDED}, h AS (SELECT contract, day, CAST(extract(hour FROM ts) AS INTEGER) AS hour, seq, side, ask, net FROM dd
 QUALIFY row_number() OVER (PARTITION BY contract, day, extract(hour FROM ts) ORDER BY round(net, 9) DESC, seq) = 1)
SELECT contract, day, hour, seq, side, {six('net')} AS net FROM h WHERE ask >= 0.15 AND round(net, 9) >= 0.02
QUALIFY row_number() OVER (PARTITION BY contract, day ORDER BY hour) = 1""")
def first_qualifying_hour(spark, d):
    s = decided(spark, d).select(
        "contract", "day", F.hour("ts").alias("hour"), "seq", F.col("side").alias("side"), F.col("ask").alias("ask"),
        F.col("net").alias("net"), F.round("net", 9).alias("_n"),
    )
    out = sel.first_hour_with_best(
        s, ["contract", "day"], "hour", "_n", ["seq"], (F.col("ask") >= 0.15) & (F.col("_n") >= 0.02)
    )
    return tidy(out.select("contract", "day", "hour", "seq", "side", "net"), "net")


@query("top_candidates", "F7", f"""WITH {SNAP} SELECT seq, contract, {six('fair_yes - yes_ask')} AS edge FROM snap WHERE yes_ask IS NOT NULL
ORDER BY round(fair_yes - yes_ask, 9) DESC, seq LIMIT 20""")
def top_candidates(spark, d):
    s = snapshots(spark, d).where(F.col("yes_ask").isNotNull()).withColumn("edge", F.col("fair_yes") - F.col("yes_ask"))
    top = s.withColumn("_n", F.round("edge", 9)).orderBy(F.desc("_n"), "seq").limit(20)
    return tidy(top.select("seq", "contract", "edge"), "edge")


@query("latest_snapshot", "F9", """SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_snapshot(spark, d):
    from marketlens.bindings.views import events

    e = events(spark, d).withColumn("day", F.to_date("ts"))
    return sel.latest_snapshot(e, "day").select("event_id", "user_id", "value")


@query("once_per_event", "I8", f"""WITH {SNAP}, s AS (SELECT seq, contract, day, ts FROM snap WHERE event_type = 'signup')
SELECT seq, contract, day, CASE WHEN row_number() OVER (PARTITION BY contract, day ORDER BY ts, seq) = 1 THEN 'SIGNAL' ELSE 'ALREADY_SIGNALED_EVENT' END AS status FROM s""")
def once_per_event(spark, d):
    s = snapshots(spark, d).where(F.col("event_type") == "signup").select("seq", "contract", "day", "ts")
    return sg.once_per_event(s, ["contract", "day"], "ts", ["seq"]).select("seq", "contract", "day", "status")


@query("top_decile_trigger", "H14", f"""WITH {DAILY}, t AS (SELECT station, day, n, count(*) OVER w AS c, list(n) OVER w AS s FROM daily
 WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT station, day, n, c AS history_n FROM t WHERE c >= 10
 AND 100.0 * (len(list_filter(s, lambda x: x < n)) + 0.5 * len(list_filter(s, lambda x: x = n))) / c >= 90""")
def top_decile_trigger(spark, d):
    w = rolling.prior_days(["station"], "day", 20)
    rows = daily(spark, d).select(
        "station", "day", "n", F.count("n").over(w).alias("history_n"), F.collect_list("n").over(w).alias("_s")
    ).withColumn("percentile", rolling.mid_rank(F.col("_s"), F.col("n")))
    return sg.top_decile_triggers(rows, "station", "day", minimum=10).select("station", "day", "n", "history_n")


@query("missing_features", "B46", """WITH f AS (SELECT event_id, event_type, value, ts FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN 'surface.slope,forecast.mean' WHEN 'view' THEN 'forecast.mean' WHEN 'error' THEN 'surface.high' ELSE '' END AS missing FROM f""")
def missing_features(spark, d):
    from marketlens.bindings.views import events

    kind = F.col("event_type")
    payload = (
        F.when(kind == "click", F.create_map(F.lit("surface.high"), F.col("value"), F.lit("surface.note"), F.lit(None).cast("double")))
        .when(kind == "view", F.create_map(F.lit("surface.high"), F.col("value"), F.lit("surface.slope"), F.col("value"), F.lit("forecast.mean"), F.lit(None).cast("double")))
        .when(kind == "error", F.create_map(F.lit("surface.slope"), F.col("value"), F.lit("forecast.mean"), F.col("value")))
        .otherwise(F.create_map(*[x for n in ("surface.high", "surface.slope", "forecast.mean") for x in (F.lit(n), F.col("value"))]))
    )
    required = F.array(*[F.lit(n) for n in ("surface.high", "surface.slope", "forecast.mean")])
    missing = sg.missing_features(payload, required, F.array(F.lit("surface.note")))
    return events(spark, d).select("event_id", F.array_join(missing, ",").alias("missing"))
