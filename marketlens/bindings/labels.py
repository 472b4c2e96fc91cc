"""Causal labels, case replay, ladders and forecast studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.bindings.books import SETTLED, fee_function, fills, market, results, settled, signals
from marketlens.bindings.registry import query
from marketlens.bindings.signals import cdf_sql
from marketlens.bindings.surface import EFFECT, FEATURES, KNN_SQL, LOOKBACK, REASONS, TOP, effects, knn, top_decile
from marketlens.bindings.views import DAILY, OBS, QUOTES, daily, observations, offset_hours, quotes, six, table
from marketlens.functions import probability as pb
from marketlens.functions.contracts import contains
from marketlens.functions.numbers import six as r6
from marketlens.functions.times import settlement_date
from marketlens.operators import forecasts as fc
from marketlens.operators import ladders, reports
from marketlens.operators.catalog import ladder_check
from marketlens.operators.ordered import ordinal
from marketlens.operators.signals import evaluated, unit_fee
from marketlens.plans.case_replay import evaluate_cases, replay
from marketlens.plans.causal_labels import label_books
from marketlens.session import cut_lineage, tasks_for


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def books(spark, d):
    """Quotes that are no purchase, with the bounds their station-day's first reading sets."""
    q = quotes(spark, d).where(F.col("event_type") != "purchase").select(
        F.col("contract").alias("station"), F.col("ts").alias("book_time"), "seq", "yes_bid", "no_bid",
        F.when(F.col("k") % 3 == 0, "below").when(F.col("k") % 3 == 1, "bucket").otherwise("above").alias("shape"),
    ).withColumn("day", settlement_date(F.col("book_time"), offset_hours(F.col("station"))))
    days = daily(spark, d).select("station", "day", F.floor("forecast").cast("double").alias("_b"), F.col("n").alias("_n"))
    return q.join(days, ["station", "day"]).select(
        "station", "day", "book_time", "seq", "shape", "yes_bid", "no_bid",
        F.when(F.col("shape") != "below", F.col("_b")).alias("lower"),
        F.when(F.col("shape") != "above", F.col("_b") + 30 + F.col("_n")).alias("upper"),
    )


LABELS = f"""{OBS}, o2 AS (SELECT * FROM obs WHERE event_type = 'purchase' OR k > 20),
daily AS (SELECT station, day, max(temp) AS high, count(*) AS n, arg_min(temp, struct_pack(t := valid_time, s := seq)) AS forecast, floor(max(temp) + 0.5) AS official FROM obs GROUP BY ALL),
bk0 AS (SELECT station, day, valid_time AS book_time, seq, round(0.02 + k * 0.0094::DOUBLE, 4) AS yes_bid, round(0.97 - round(0.02 + k * 0.0094::DOUBLE, 4), 4) AS no_bid,
 CASE WHEN k % 3 = 0 THEN 'below' WHEN k % 3 = 1 THEN 'bucket' ELSE 'above' END AS shape FROM obs WHERE event_type <> 'purchase'),
bk AS (SELECT b.*, CASE WHEN shape <> 'below' THEN floor(d.forecast) END AS lower, CASE WHEN shape <> 'above' THEN floor(d.forecast) + 30 + d.n END AS upper FROM bk0 b JOIN daily d USING (station, day)),
st0 AS (SELECT b.seq, max(struct_pack(v := o.temp, t := o.valid_time)) AS hi, max(struct_pack(t := o.valid_time, v := o.temp)) AS la,
 min(CASE WHEN o.valid_time >= b.book_time - INTERVAL {LOOKBACK} SECOND THEN struct_pack(t := o.valid_time, v := o.temp) END) AS fi
 FROM bk b LEFT JOIN o2 o ON o.station = b.station AND o.day = b.day AND o.valid_time <= b.book_time GROUP BY b.seq),
st AS (SELECT b.*, hi.v AS high, la.v AS latest, (epoch_us(b.book_time) - epoch_us(hi.t)) / 6e7 AS minutes, hi.v - la.v AS fall,
 CASE WHEN la.t > fi.t THEN (la.v - fi.v) / ((epoch_us(la.t) - epoch_us(fi.t)) / 6e7) END AS slope FROM bk b JOIN st0 USING (seq)),
pp AS (SELECT s.seq, count(h.station) AS pn, avg(CASE WHEN h.station IS NULL THEN NULL WHEN s.shape = 'below' THEN (s.high + (h.official - h.high) < s.upper)::INT
 WHEN s.shape = 'above' THEN (s.high + (h.official - h.high) > s.lower)::INT ELSE (s.high + (h.official - h.high) BETWEEN s.lower AND s.upper)::INT END) AS p
 FROM st s LEFT JOIN daily h ON h.station = s.station AND h.day < s.day AND h.n >= 2 GROUP BY s.seq),
lb0 AS (SELECT st.*, {REASONS} = '' AND high IS NOT NULL AS locked, CASE WHEN pn >= 5 AND high IS NOT NULL THEN p END AS p FROM st JOIN pp USING (seq)),
lb1 AS (SELECT *, 1 - no_bid AS yes_ask, 1 - yes_bid AS no_ask, p - (1 - no_bid) AS ye, (1 - p) - (1 - yes_bid) AS ne FROM lb0),
lb AS (SELECT *, round(ye, 9) >= round(ne, 9) AS yf, CASE WHEN round(ye, 9) >= round(ne, 9) THEN ye ELSE ne END AS edge FROM lb1),
labels AS (SELECT *, CASE WHEN p IS NULL THEN 'INSUFFICIENT_PRIOR' WHEN NOT locked THEN 'LOCK_GATE_FAIL' WHEN round(edge, 9) < 0.05 THEN 'NO_EDGE' ELSE 'CANDIDATE' END AS status FROM lb)"""


def labelled(spark, d):
    o = observations(spark, d).where((F.col("event_type") == "purchase") | (F.col("k") > 20))
    history = daily(spark, d).withColumn("basis", F.col("official") - F.col("high")).select("station", "day", "basis", "n")
    return label_books(books(spark, d), o, history, usable=F.col("n") >= 2, minimum_samples=5, slope_seconds=LOOKBACK)


@query("causal_labels", "H9 C4 E4 E5 C5 B13", f"""WITH {LABELS} SELECT station, day, seq, status, locked, {six('p')} AS p_yes, CASE WHEN status = 'CANDIDATE' THEN CASE WHEN yf THEN 'YES' ELSE 'NO' END END AS side,
 CASE WHEN status = 'CANDIDATE' THEN {six('CASE WHEN yf THEN yes_ask ELSE no_ask END')} END AS price, CASE WHEN status = 'CANDIDATE' THEN {six('edge')} END AS edge FROM labels""")
def causal_labels(spark, d):
    out = labelled(spark, d).select("station", "day", "seq", "status", "locked", "p_yes", "side", "price", "edge")
    return tidy(out, "p_yes", "price", "edge")


@query("label_counts", "H9 D23", f"WITH {LABELS} SELECT status, count(*) AS books, count(DISTINCT station) AS stations, count(DISTINCT day) AS days FROM labels GROUP BY status")
def label_counts(spark, d):
    return labelled(spark, d).groupBy("status").agg(
        F.count(F.lit(1)).alias("books"), F.count_distinct("station").alias("stations"), F.count_distinct("day").alias("days")
    )


def cases(spark, d):
    k = F.col("k")
    features = F.when(k % 10 == 0, F.create_map(F.lit("surface.high"), F.col("value"))).otherwise(
        F.create_map(F.lit("surface.high"), F.col("value"), F.lit("forecast.p"), F.when(k % 10 != 1, k * 37 % 100 / 100))
    )
    s = signals(spark, d).withColumnRenamed("signal_id", "case_id").drop("strategy", "side")
    q = quotes(spark, d).select(F.col("seq").alias("case_id"), features.alias("features"), "yes_ask", "no_ask")
    return s.join(q, "case_id")


def ask_strategy(df):
    """Buy the better side of the forecast probability."""
    p = F.try_element_at("features", F.lit("forecast.p"))
    out = evaluated(df, p, F.col("yes_ask"), F.col("no_ask"), 0.02, F.lit(None).cast("string"))
    return out.drop("yes_ask", "no_ask")


CASES = QUOTES + """, ev2 AS (SELECT seq AS case_id, contract, ts AS signal_time, CAST(ts AS DATE) AS date, CASE WHEN k % 10 NOT IN (0, 1) THEN k * 37 % 100 / 100 END AS p, k, yes_ask, no_ask FROM quotes WHERE event_type = 'signup'),
ed AS (SELECT *, p - yes_ask AS ye, (1 - p) - no_ask AS ne FROM ev2),
evl AS (SELECT *, CASE WHEN k % 10 IN (0, 1) THEN 'MISSING_REGISTERED_FEATURES:forecast.p' WHEN greatest(ye, ne) < 0.02 THEN 'EDGE_BELOW_MINIMUM' ELSE 'ELIGIBLE' END AS reason,
 CASE WHEN k % 10 NOT IN (0, 1) THEN CASE WHEN ye >= ne THEN 'YES' ELSE 'NO' END END AS side FROM ed)"""


@query("case_evaluations", "B46 J1", f"WITH {CASES} SELECT case_id, reason, side, {six('CASE WHEN side IS NOT NULL THEN greatest(ye, ne) END')} AS edge FROM evl")
def case_evaluations(spark, d):
    out = evaluate_cases(cases(spark, d), ask_strategy, ["surface.high", "forecast.p"])
    return tidy(out.select("case_id", "reason", "side", "edge"), "edge")


@query("case_replay", "H17 H16 I7 C18 D17", f"""WITH {CASES}, book AS (SELECT * FROM quotes WHERE event_type <> 'signup'), sg AS (SELECT * FROM evl WHERE reason = 'ELIGIBLE'),
m AS (SELECT s.case_id, s.contract, s.side, s.date, min(struct_pack(t := b.ts, e := b.seq)) AS h FROM sg s JOIN book b ON b.contract = s.contract AND b.ts >= s.signal_time + INTERVAL 300 SECOND GROUP BY ALL),
f AS (SELECT m.*, least(5, CAST(floor(b.size) AS BIGINT)) AS q, least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, CASE WHEN m.side = 'YES' THEN b.yes_ask ELSE b.no_ask END)) AS price FROM m JOIN book b ON b.seq = m.h.e),
g AS (SELECT *, CAST(ceil(0.07::DECIMAL(5,4) * q::DECIMAL(10,2) * price::DECIMAL(9,6) * (1::DECIMAL(1,0) - price::DECIMAL(9,6)) * 100::DECIMAL(3,0)) AS DOUBLE) / 100 AS fee FROM f),
r AS (SELECT user_id AS contract, CASE WHEN arg_max(event_type, struct_pack(t := ts, e := event_id)) IN ('purchase', 'click') THEN 'YES' ELSE 'NO' END AS result FROM ev GROUP BY user_id),
s AS (SELECT g.*, CASE WHEN g.side = r.result THEN q ELSE 0 END - q * price - fee AS pnl, q * price + fee AS cap FROM g JOIN r USING (contract)),
mk AS (SELECT g.case_id, g.side, g.price, min(struct_pack(t := b.ts, e := b.seq)) AS h FROM g JOIN sg USING (case_id) JOIN book b ON b.contract = g.contract AND b.ts >= sg.signal_time + INTERVAL 900 SECOND GROUP BY ALL),
mo AS (SELECT avg(CASE WHEN mk.side = 'YES' THEN b.yes_bid ELSE b.no_bid END - mk.price) AS m FROM mk JOIN book b ON b.seq = mk.h.e)
SELECT 'ask_rule' AS strategy, (SELECT count(*) FROM evl) AS evaluations, (SELECT count(*) FROM sg) AS signals, count(*) AS fills, count(*) FILTER (pnl > 0) AS wins, count(DISTINCT date) AS dates,
 {six('sum(pnl)')} AS net, {six('sum(cap)')} AS capital, {six('sum(pnl) / sum(cap)')} AS roi, {six('(SELECT m FROM mo)')} AS markout_900 FROM s""")
def case_replay(spark, d):
    card = replay(
        cases(spark, d), market(spark, d), results(spark, d), ask_strategy, name="ask_rule", required=["surface.high", "forecast.p"],
        fee=fee_function, latency=F.lit(300), contracts=5,
    )
    return card.select(
        "strategy", "evaluations", "signals", "fills", "wins", "dates", r6(F.col("net")).alias("net"), r6(F.col("capital")).alias("capital"),
        r6(F.col("roi")).alias("roi"), r6(F.element_at("markouts", F.lit(900).cast("bigint"))).alias("markout_900"),
    )


def legs(spark, d):
    """Lines of an order as ladder legs: a tail, buckets of one degree, a tail; some are spoiled."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    key = ["l_partkey", "l_suppkey", "l_linenumber"]
    placed = ordinal(li.repartition(tasks_for(li.count()), "event_id"), ["event_id"], key, "pos", None)  # an event has a handful of legs
    out = placed.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("event_id")))
    pos, q, disc = F.col("pos"), F.col("l_quantity"), F.col("l_discount")
    shape = F.when(pos == 1, "below").when(pos == F.col("_size"), "above").otherwise("bucket")
    base = pos.cast("double") + 60
    spoiled = F.when(q <= 2, 0.5).when(q <= 6, 1.0).otherwise(0.0)
    text = lambda c: F.lit(c)
    return out.select(
        "event_id", pos.alias("pos"), F.concat_ws("-", "event_id", F.when(disc == 0.1, F.lit(1)).otherwise(pos)).alias("ticker"), shape.alias("shape"),
        F.when(shape != "below", base + spoiled).alias("lower"), F.when(shape != "above", base).alias("upper"),
        F.lit(True).alias("lower_inclusive"), F.lit(True).alias("upper_inclusive"),
        F.when(q == 50, "PROBABLE").otherwise("EXACT").alias("mapping_status"), text("rules").alias("evidence"), text("NWS").alias("source"),
        text("KNYC").alias("station"), F.when(q == 49, "2024-01-02").otherwise("2024-01-01").alias("date"), text("DAILY_HIGH").alias("measurement"),
        text("LST").alias("window"), text("F").alias("unit"), text("WHOLE_DEGREE").alias("rounding"), text("INTEGER").alias("value_domain"),
        F.round(0.04 + disc, 4).alias("yes_ask"), F.round(F.lit(0.9) - F.col("l_tax"), 4).alias("no_ask"),
    )


LEGS = """ll AS (SELECT l_orderkey AS event_id, l_quantity AS q, l_discount AS di, l_tax AS tx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS pos,
 count(*) OVER (PARTITION BY l_orderkey) AS sz FROM lineitem),
lg AS (SELECT *, CASE WHEN di = 0.1 THEN 1 ELSE pos END AS tk, CASE WHEN pos = 1 THEN 'below' WHEN pos = sz THEN 'above' ELSE 'bucket' END AS shape, CASE WHEN q <= 2 THEN 0.5 WHEN q <= 6 THEN 1 ELSE 0 END::DOUBLE AS sp FROM ll),
lh AS (SELECT *, CASE WHEN shape <> 'below' THEN pos + 60 + sp END AS lo, CASE WHEN shape <> 'above' THEN (pos + 60)::DOUBLE END AS hi FROM lg),
le AS (SELECT *, lag(hi) OVER w AS phi, row_number() OVER w AS rn FROM lh WINDOW w AS (PARTITION BY event_id ORDER BY lo IS NOT NULL, lo, pos)),
pf AS (SELECT event_id, count(*) AS legs, count(DISTINCT tk) AS tk, bool_or(q = 50) AS unv, count(DISTINCT q = 49) AS basis,
 arg_min(CASE WHEN lo <> floor(lo) THEN 'NONINTEGER_BOUND' WHEN lo > hi THEN 'EMPTY_OR_REVERSED_INTERVAL' END, pos) FILTER (lo <> floor(lo) OR lo > hi) AS bad,
 bool_or(rn > 1 AND (phi IS NULL OR lo IS NULL)) AS tails, arg_max(hi IS NOT NULL, struct_pack(a := lo IS NOT NULL, b := lo, c := pos)) AS tophi, bool_or(rn > 1 AND phi + 1 <> lo) AS gap FROM le GROUP BY event_id),
proof AS (SELECT event_id, legs, CASE WHEN legs < 3 THEN 'TOO_FEW_LEGS' WHEN tk <> legs THEN 'DUPLICATE_OR_MISSING_CONTRACT' WHEN unv THEN 'SETTLEMENT_SEMANTICS_UNVERIFIED' WHEN basis > 1 THEN 'MIXED_SETTLEMENT_BASIS'
 WHEN bad IS NOT NULL THEN bad WHEN tophi THEN 'UNBOUNDED_TAILS_MISSING' WHEN tails THEN 'OVERLAPPING_TAILS' WHEN gap THEN 'GAP_OR_OVERLAP' ELSE 'EXACT_PARTITION' END AS reason FROM pf)"""


@query("ladder_proof", "E15 A22", f"WITH {LEGS} SELECT event_id, legs, reason FROM proof")
def ladder_proof(spark, d):
    return proven(spark, d, legs(spark, d))


def proven(spark, d, rows):
    return ladders.ladder_proof(rows, rows.select("event_id", "ticker").distinct(), tasks=tasks_for(table(spark, d, "lineitem").count()))


def fee_text(p):
    return f"(CAST(ceil(0.07::DECIMAL(5,4) * ({p})::DECIMAL(9,6) * (1::DECIMAL(1,0) - ({p})::DECIMAL(9,6)) * 100::DECIMAL(3,0)) AS DOUBLE) / 100)"


@query("ladder_underround", "H12", f"""WITH {LEGS}, c AS (SELECT event_id, count(*) AS n, sum(round(0.04 + di, 4) + {fee_text('round(0.04 + di, 4)')}) AS y, sum(round(0.9 - tx, 4) + {fee_text('round(0.9 - tx, 4)')}) AS o FROM lh
 WHERE event_id IN (SELECT event_id FROM proof WHERE reason = 'EXACT_PARTITION') GROUP BY event_id)
SELECT event_id, n AS n_legs, 'BASKET_YES' AS side, {six('1 - y')} AS edge FROM c WHERE round(1 - y, 9) >= 0.05 UNION ALL SELECT event_id, n, 'BASKET_NO', {six('n - 1 - o')} FROM c WHERE round(n - 1 - o, 9) >= 0.05""")
def ladder_underround(spark, d):
    rows = legs(spark, d)
    proof = proven(spark, d, rows)
    priced = rows.withColumns({"yes_fee": unit_fee(F.col("yes_ask")), "no_fee": unit_fee(F.col("no_ask"))})
    out = ladders.underround(priced, proof, 0.05 - 1e-9)
    return tidy(out.select("event_id", "n_legs", "side", "edge"), "edge")


@query("best_run", "E14", f"""WITH l AS (SELECT o_custkey AS event, l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount AS fair, l_tax AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT event, fair, cost, row_number() OVER (PARTITION BY event ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS pos FROM l),
r AS (SELECT a.event, a.pos, b.pos - a.pos + 1 AS n, round(sum(b.fair - b.cost) OVER (PARTITION BY a.event, a.pos ORDER BY b.pos ROWS UNBOUNDED PRECEDING), 9) AS edge FROM p a JOIN p b ON a.event = b.event AND b.pos BETWEEN a.pos AND a.pos + 5)
SELECT event, {six('edge')} AS edge, pos AS first_leg, n AS run_legs FROM r WHERE edge >= 0.02 QUALIFY row_number() OVER (PARTITION BY event ORDER BY edge DESC, pos, n) = 1""")
def best_run(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(
        F.col("o_custkey").alias("event"), "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_discount").alias("fair"), F.col("l_tax").alias("cost"),
    )
    out = ladders.best_run(
        rows, ["event"], ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], F.floor(F.col("l_extendedprice") / 1000), chunk=16,
        tasks=tasks_for(table(spark, d, "lineitem").count()),
    )
    return tidy(out, "edge")


@query("ladder_check", "D22", """SELECT l_orderkey AS event, count(*) AS contracts, count(DISTINCT l_returnflag) AS "values", count(*) FILTER (l_linestatus = 'F') AS winners, min(l_returnflag) AS settlement_value,
 count(DISTINCT l_returnflag) = 1 AND count(*) FILTER (l_linestatus = 'F') = 1 AS valid FROM lineitem GROUP BY l_orderkey""")
def ladder_check_query(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "event")
    return ladder_check(li, ["event"], value="l_returnflag", won=F.col("l_linestatus") == "F")


@query("gaussian_ladder", "B19 B20 B21", f"""WITH b AS (SELECT p_brand AS event, p_size AS s, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand AS event, avg(p_size) AS mean, stddev_pop(p_size) AS sd FROM part GROUP BY 1),
r AS (SELECT b.event, s, greatest(0, least(1, {cdf_sql('s + 0.5', 'mean', 'sd', 0.15)} - {cdf_sql('s - 0.5', 'mean', 'sd', 0.15)})) AS bucket,
 greatest(0, least(1, 1 - {cdf_sql('s - 0.5', 'mean', 'sd', 0.15)})) AS above, greatest(0, least(1, {cdf_sql('s + 0.5', 'mean', 'sd', 0.15)})) AS below FROM b JOIN m USING (event))
SELECT event, CAST(s AS INTEGER) AS size, {six('bucket')} AS bucket, {six('above')} AS above, {six('below')} AS below, {six('bucket / sum(bucket) OVER (PARTITION BY event)')} AS p FROM r""")
def gaussian_ladder(spark, d):
    part = table(spark, d, "part")
    buckets = part.select(F.col("p_brand").alias("event"), F.col("p_size").alias("size")).distinct()
    moments = part.groupBy(F.col("p_brand").alias("event")).agg(F.avg("p_size").alias("mean"), F.stddev_pop("p_size").alias("sd"))
    c = (F.col("mean"), F.col("sd"))
    rows = buckets.join(moments, "event").select(
        "event", "size", pb.gaussian_bucket(*c, F.col("size"), F.col("size")).alias("bucket"), pb.gaussian_above(*c, F.col("size")).alias("above"),
        pb.gaussian_below(*c, F.col("size")).alias("below"),
    )
    return tidy(ladders.normalized_probabilities(rows, ["event"], "bucket"), "bucket", "above", "below", "p")


@query("ensemble_distribution", "D30", f"""WITH {OBS}, m AS (SELECT station, day, event_type, max(temp) AS t FROM obs GROUP BY ALL) SELECT station, day, count(*) AS members, {six('avg(t)')} AS mean,
 {six('greatest(0.75::DOUBLE, coalesce(stddev_pop(t), 0))')} AS sigma FROM m GROUP BY ALL""")
def ensemble_distribution(spark, d):
    return tidy(fc.ensemble_distribution(observations(spark, d), ["station", "day"], "event_type", "temp"), "mean", "sigma")


TREND = f"""{OBS}, cu AS (SELECT station, max(struct_pack(t := valid_time, v := temp)) AS m FROM obs WHERE event_type = 'click' GROUP BY 1), pr AS (SELECT station, max(struct_pack(t := valid_time, v := temp)) AS m FROM obs WHERE event_type = 'view' GROUP BY 1),
sl AS (SELECT cu.station, (cu.m.v - pr.m.v) / h AS slope FROM (SELECT cu.station, (epoch_us(cu.m.t) - epoch_us(pr.m.t)) / 3.6e9 AS h FROM cu JOIN pr USING (station)) x JOIN cu USING (station) JOIN pr USING (station) WHERE h BETWEEN 0.03 AND 120)"""


def station_slopes(spark, d):
    o = observations(spark, d)

    def newest(kind):
        return o.where(F.col("event_type") == kind).groupBy("station").agg(F.max(F.struct("valid_time", "temp")).alias("_m")).select(
            "station", F.col("_m.valid_time").alias("ts"), F.col("_m.temp").alias("temp")
        )

    return fc.station_trend(newest("click"), newest("view"), "station", high_h=120.0)


@query("station_trend", "C15", f"WITH {TREND} SELECT station, {six('slope')} AS slope FROM sl")
def station_trend(spark, d):
    return tidy(station_slopes(spark, d), "slope")


@query("nowcast", "D31", f"""WITH {TREND}, tr AS (SELECT station % 10 AS region, avg(slope) AS trend, coalesce(stddev_pop(slope), 0) AS disp, count(*) AS n FROM sl GROUP BY 1),
fm AS (SELECT station % 10 AS region, event_type, avg(temp) AS mean, stddev_pop(temp) / 20 AS sigma FROM obs GROUP BY ALL),
bl AS (SELECT region, sum(mean / pow(greatest(sigma, 0.75::DOUBLE), 2)) / sum(1 / pow(greatest(sigma, 0.75::DOUBLE), 2)) AS fmean, greatest(0.75::DOUBLE, avg(sigma)) AS fsig FROM fm GROUP BY 1),
an AS (SELECT station % 10 AS region, max(struct_pack(t := valid_time, s := seq, v := temp)) AS m FROM obs GROUP BY 1),
a AS (SELECT region, m.v AS temp, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(m.t)) / 6e7) AS age, coalesce(trend, 0) AS trend, fmean, fsig, disp, n FROM an LEFT JOIN tr USING (region) LEFT JOIN bl USING (region)),
b AS (SELECT *, temp + greatest(-2.5::DOUBLE, least(2.5::DOUBLE, trend * least(age / 60, 0.5::DOUBLE))) AS now, least(0.55::DOUBLE, 0.12::DOUBLE + age / 120) AS w FROM a),
c AS (SELECT *, greatest(temp, (1 - w) * now + w * fmean) AS high, greatest(0.55::DOUBLE, least(4, 0.55::DOUBLE + 0.2::DOUBLE * fsig + 0.18::DOUBLE * abs(fmean - now) + 0.08::DOUBLE * CASE WHEN n > 1 THEN disp ELSE 0 END)) AS s FROM b)
SELECT region, {six('now')} AS estimated_now, {six('high')} AS projected_high, {six('s')} AS sigma, {six('trend')} AS trend, {six('fmean')} AS forecast_mean,
 {six('greatest(0, least(1, exp(-0.35::DOUBLE * s) * exp(-0.01::DOUBLE * age)))')} AS confidence FROM c""")
def nowcast(spark, d):
    o = observations(spark, d).withColumn("region", F.col("station") % 10)
    anchors = o.groupBy("region").agg(F.max(F.struct("valid_time", "seq", "temp")).alias("_m")).select(
        "region", F.col("_m.valid_time").alias("observed_at"), F.col("_m.temp").alias("temp")
    )
    trends = fc.trend_summary(station_slopes(spark, d).withColumn("region", F.col("station") % 10), ["region"])
    models = o.groupBy("region", "event_type").agg(F.avg("temp").alias("mean"), (F.stddev_pop("temp") / 20).alias("sigma"))
    out = fc.nowcast(anchors, trends, fc.blend(models, ["region"]), "region", F.lit("2024-01-31").cast("timestamp"))
    return tidy(out, "estimated_now", "projected_high", "sigma", "trend", "forecast_mean", "confidence")


@query("activity_panel", "D21", f"""WITH {DAILY}, x AS (SELECT station, day, CAST(n AS DOUBLE) AS cnt, high AS top, max(day) OVER (PARTITION BY station) AS last FROM daily),
t AS (SELECT * FROM x WHERE day = last), b AS (SELECT * FROM x WHERE day < last),
s AS (SELECT b.station, count(*) AS baseline_days, avg(b.cnt) AS cm, avg(b.top) AS tm, 100.0 * avg((b.cnt <= t.cnt)::INT) AS cp, 100.0 * avg((b.top <= t.top)::INT) AS tp, median(b.cnt) AS cd, median(b.top) AS td FROM b JOIN t ON t.station = b.station GROUP BY 1),
g AS (SELECT b.station, median(abs(b.cnt - cd)) AS ca, median(abs(b.top - td)) AS ta FROM b JOIN s ON s.station = b.station GROUP BY 1)
SELECT station, baseline_days, cnt, top, {six('cm')} AS cnt_mean, {six('tm')} AS top_mean, {six('cp')} AS cnt_pct, {six('tp')} AS top_pct, {six('cd')} AS cnt_median, {six('td')} AS top_median,
 CASE WHEN ca <> 0 THEN {six('0.67448975::DOUBLE * (cnt - cd) / ca')} END AS cnt_z, CASE WHEN ta <> 0 THEN {six('0.67448975::DOUBLE * (top - td) / ta')} END AS top_z, {six('(cp + tp) / 2')} AS activity_pct
FROM t LEFT JOIN s USING (station) LEFT JOIN g USING (station)""")
def activity_panel(spark, d):
    x = cut_lineage(daily(spark, d).select("station", "day", F.col("n").cast("double").alias("cnt"), F.col("high").alias("top")))  # read three times
    last = x.groupBy("station").agg(F.max("day").alias("last"))
    x = x.join(last, "station")
    out = fc.activity_panel(x.where(F.col("day") == F.col("last")), x.where(F.col("day") < F.col("last")), "station", ["cnt", "top"])
    return tidy(out, *[c for c in out.columns if c not in ("station", "baseline_days", "cnt", "top")])


BUCKETS = "(SELECT unnest(generate_series(0, 4)) AS pos)"


def ladder_of_day(df, base):
    """Five contiguous contracts around a base value: a tail, three buckets, a tail."""
    out = df.withColumn("pos", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    shape = F.when(F.col("pos") == 0, "below").when(F.col("pos") == 4, "above").otherwise("bucket")
    return out.withColumns({
        "shape": shape, "lower": F.when(F.col("pos") > 0, base + F.col("pos") * 10.0), "upper": F.when(F.col("pos") < 4, base + F.col("pos") * 10.0 + 9),
    })


INSIDE = "CASE WHEN pos = 0 THEN {v} < up WHEN pos = 4 THEN {v} > lw ELSE {v} BETWEEN lw AND up END"
LADDER5 = "CASE WHEN pos > 0 THEN base + pos * 10 END AS lw, CASE WHEN pos < 4 THEN base + pos * 10 + 9 END AS up"


@query("hourly_hit_study", "D27", f"""WITH {FEATURES}, {KNN_SQL}, x AS (SELECT f.*, p.residuals AS s, p.med, floor(f.high / 10) * 10 - 10 AS base FROM features f JOIN pred p USING (station, day, hour) WHERE p.n >= 6),
y AS (SELECT *, {LADDER5} FROM x, {BUCKETS}), z AS (SELECT *, len(list_filter(s, lambda r: {INSIDE.format(v='(high + r)')})) / len(s) AS p, {INSIDE.format(v='high')} AS cur, {INSIDE.format(v='official')} AS won FROM y),
c AS (SELECT station, day, hour, arg_max(won, struct_pack(p := p, o := -pos)) AS t, bool_or(cur AND won) AS h, sum(CASE WHEN won THEN p ELSE 0 END) AS wp, max(abs(high + med - official)) AS e FROM z GROUP BY ALL)
SELECT hour, count(*) AS cases, count(*) FILTER (t) AS top_hits, count(*) FILTER (h) AS current_hits, {six('avg(e)')} AS mae, {six('avg(wp)')} AS mean_winner_p FROM c GROUP BY hour""")
def hourly_hit_study(spark, d):
    rows = knn(spark, d).where(F.col("neighbours") >= 6).withColumn("case", F.struct("station", "day"))
    wide = ladder_of_day(rows, F.floor(F.col("high") / 10) * 10.0 - 10)
    b = (F.col("shape"), F.col("lower"), F.col("upper"))
    inside = F.filter("residuals", lambda r: contains(*b, F.col("high") + r, on_bad="false"))
    wide = wide.withColumns({
        "p": F.size(inside) / F.size("residuals"), "in_now": contains(*b, F.col("high")), "won": contains(*b, F.col("official")),
        "abs_error": F.abs(F.col("high") + F.col("median_residual") - F.col("official")),
    })
    return tidy(fc.hit_study(wide, ["hour"]), "mae", "mean_winner_p")


@query("adjustment_study", "D28 B21", f"""WITH {DAILY}, {TOP}, {EFFECT}, x AS (SELECT t.station, t.day, d.forecast, d.official, 5 + d.n AS sd, e.effect, floor(d.forecast / 10) * 10 - 10 AS base FROM top t JOIN daily d USING (station, day) JOIN effect e USING (day)
 WHERE t.pct >= 90 AND e.effect IS NOT NULL), y AS (SELECT *, {LADDER5} FROM x, {BUCKETS}),
q AS (SELECT *, {INSIDE.format(v='official')} AS won, CASE WHEN pos = 0 THEN {cdf_sql('up - 0.5', 'forecast', 'sd', 0.75)} WHEN pos = 4 THEN 1 - {cdf_sql('lw + 0.5', 'forecast', 'sd', 0.75)} ELSE {cdf_sql('up + 0.5', 'forecast', 'sd', 0.75)} - {cdf_sql('lw - 0.5', 'forecast', 'sd', 0.75)} END AS b0,
 CASE WHEN pos = 0 THEN {cdf_sql('up - 0.5', 'forecast + effect', 'sd', 0.75)} WHEN pos = 4 THEN 1 - {cdf_sql('lw + 0.5', 'forecast + effect', 'sd', 0.75)} ELSE {cdf_sql('up + 0.5', 'forecast + effect', 'sd', 0.75)} - {cdf_sql('lw - 0.5', 'forecast + effect', 'sd', 0.75)} END AS a0 FROM y),
z AS (SELECT *, greatest(0, b0) / sum(greatest(0, b0)) OVER w AS bp, greatest(0, a0) / sum(greatest(0, a0)) OVER w AS ap FROM q WINDOW w AS (PARTITION BY station, day)),
c AS (SELECT station, day, arg_max(won, struct_pack(p := round(bp, 9), o := -pos)) AS bh, arg_max(won, struct_pack(p := round(ap, 9), o := -pos)) AS ah, sum(CASE WHEN won THEN ap - bp ELSE 0 END) AS ch, any_value(official - forecast) AS er FROM z GROUP BY ALL)
SELECT count(*) AS cases, count(DISTINCT day) AS dates, {six('avg(er)')} AS mean_error, count(*) FILTER (bh) AS base_hits, count(*) FILTER (ah) AS adj_hits, count(*) FILTER (NOT bh AND ah) AS corrected,
 count(*) FILTER (bh AND NOT ah) AS harmed, {six('avg(ch)')} AS mean_change FROM c""")
def adjustment_study(spark, d):
    marked = top_decile(spark, d).where("top_decile").join(effects(spark, d).where(F.col("effect").isNotNull()), "day")
    wide = ladder_of_day(marked, F.floor(F.col("forecast") / 10) * 10.0 - 10)
    strike = F.when(F.col("shape") == "below", "less").when(F.col("shape") == "above", "greater").otherwise("between")
    sd = (5 + F.col("n")).cast("double")

    def p(mean):
        return pb.strike_probability(strike, F.col("lower"), F.col("upper"), mean, sd, on_bad="zero")

    rows = wide.withColumns({
        "b0": p(F.col("forecast")), "a0": p(F.col("forecast") + F.col("effect")), "case": F.struct("station", "day"), "date": F.col("day"),
        "error": F.col("official") - F.col("forecast"), "won": contains(F.col("shape"), F.col("lower"), F.col("upper"), F.col("official")),
    })
    rows = ladders.normalized_probabilities(rows, ["case"], "b0", "bp")
    rows = ladders.normalized_probabilities(rows, ["case"], "a0", "ap").withColumns({"base_p": F.round("bp", 9), "adj_p": F.round("ap", 9)})
    return tidy(fc.adjustment_study(rows), "mean_error", "mean_change")


@query("daily_report", "D25 F8", f"""WITH {SETTLED}, co AS (SELECT contract, CAST(ts AS DATE) AS day, arg_max(value >= 60, struct_pack(t := ts, s := seq)) AS ok FROM quotes GROUP BY ALL),
sd AS (SELECT date AS day, count(*) AS signals FROM sig GROUP BY 1), fd AS (SELECT CAST(fill_time AS DATE) AS day, count(*) AS fills FROM fills WHERE status = 'FILLED' GROUP BY 1),
md AS (SELECT CAST(fill_time AS DATE) AS day, count(*) AS settled, count(*) FILTER (won) AS wins, sum(pnl) AS net, sum(capital) AS capital FROM settled GROUP BY 1),
cd AS (SELECT day, count(*) AS contracts, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND NOT EXISTS (SELECT 1 FROM sig WHERE sig.contract = co.contract AND sig.date = co.day)) AS missed FROM co GROUP BY 1)
SELECT day, coalesce(signals, 0) AS signals, coalesce(fills, 0) AS fills, coalesce(contracts, 0) AS contracts, coalesce(eligible, 0) AS eligible, coalesce(missed, 0) AS missed, coalesce(settled, 0) AS settled,
 coalesce(wins, 0) AS wins, coalesce(settled - wins, 0) AS losses, {six('coalesce(net, 0)')} AS net, {six('net / capital')} AS roi
FROM cd FULL JOIN sd USING (day) FULL JOIN fd USING (day) FULL JOIN md USING (day)""")
def daily_report(spark, d):
    filled = fills(spark, d).where(F.col("status") == "FILLED").withColumn("day", F.to_date("fill_time"))
    paid = settled(spark, d).withColumn("day", F.to_date("fill_time"))
    rows = quotes(spark, d).withColumn("day", F.to_date("ts"))
    out = reports.daily_report(
        signals(spark, d).withColumn("day", F.col("date")), filled, paid, rows, contract="contract", event="contract", order=["ts", "seq"],
        eligible=F.col("value") >= 60,
    )
    return tidy(out.drop("capital"), "net", "roi")
