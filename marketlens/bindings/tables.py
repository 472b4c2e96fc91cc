"""Keyed facts, joins by key, set operations and feed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import DAILY, EVENTS, OBS, QUOTES, daily, events, observations, orders, quotes, six, table, two
from marketlens.functions.contracts import boundary_distance, contains, flips
from marketlens.functions.dimensions import fee_rates
from marketlens.functions.numbers import fee_unrounded, quote_dollars
from marketlens.functions.numbers import six as r6
from marketlens.functions.numbers import two as r2
from marketlens.functions.times import naive
from marketlens.operators import books, feeds, ladders
from marketlens.operators import tables as tb
from marketlens.operators.ordered import latest_per_key, ordinal, time_block


def tidy(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("latest_per_key", "A5 A12 G4", """SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey,
 arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey""")
def latest(spark, d):
    return latest_per_key(orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("upsert_facts", "A12", """WITH n AS (SELECT o_custkey AS id, o_totalprice AS payload, o_orderkey AS version FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT c_custkey AS id, c_acctbal AS payload, -1 AS version FROM customer UNION ALL SELECT * FROM n)
SELECT id, arg_max(payload, version) AS payload, max(version) AS version FROM u GROUP BY id""")
def upsert_facts(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("payload"), F.lit(-1).cast("bigint").alias("version"))
    new = orders(spark, d).where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("payload"), F.col("o_orderkey").alias("version")
    )
    return tb.upsert(old, new, ["id"], ["version"])


@query("merge_refreshed", "A17", """WITH f AS (SELECT o_custkey AS id, max(o_totalprice) AS v, CASE WHEN max(o_totalprice) < 200000 THEN 'late' END AS error FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN f.id IS NOT NULL AND f.error IS NULL THEN f.v ELSE c_acctbal END AS v FROM customer LEFT JOIN f ON f.id = c_custkey
UNION ALL SELECT id, v FROM f WHERE error IS NULL AND id NOT IN (SELECT c_custkey FROM customer)""")
def merge_refreshed(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(None).cast("string").alias("error"))
    top = F.max("o_totalprice")
    new = orders(spark, d).groupBy(F.col("o_custkey").alias("id")).agg(top.alias("v"), F.when(top < 200000, "late").alias("error"))
    return tb.merge_refreshed(old, new, ["id"], "error").select("id", "v")


@query("merge_tiers", "A18", """WITH live AS (SELECT CASE WHEN event_type <> 'error' THEN event_id END AS id, user_id, value, 0 AS tier FROM events WHERE event_type IN ('click', 'error', 'view')),
arch AS (SELECT event_id AS id, user_id, value + 1 AS value, 1 AS tier FROM events WHERE event_type IN ('view', 'purchase')),
b AS (SELECT *, coalesce(CAST(id AS VARCHAR), 'row' || user_id || '/' || value) AS k FROM (SELECT * FROM live UNION ALL SELECT * FROM arch))
SELECT arg_max(id, tier) AS id, any_value(user_id) AS user_id, arg_max(value, tier) AS value FROM b GROUP BY k""")
def merge_tiers(spark, d):
    e = events(spark, d)
    live = e.where(F.col("event_type").isin("click", "error", "view")).select(
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("id"), "user_id", "value"
    )
    archived = e.where(F.col("event_type").isin("view", "purchase")).select(F.col("event_id").alias("id"), "user_id", (F.col("value") + 1).alias("value"))
    return tb.merge_tiers(live, archived, "id")


@query("fallback_when_empty", "A18 G5", """SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'view' UNION ALL SELECT e.event_id, e.user_id, CAST(e.ts AS DATE), e.value
FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND CAST(v.ts AS DATE) = CAST(e.ts AS DATE))""")
def fallback_when_empty(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts")).select("event_type", "event_id", "user_id", "day", "value")
    return tb.fallback_when_empty(
        e.where(F.col("event_type") == "view").drop("event_type"), e.where(F.col("event_type") == "click").drop("event_type"), ["user_id", "day"]
    )


@query("pick_source", "G5 G4", """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, value, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rk FROM events WHERE event_type <> 'error'),
s AS (SELECT user_id, day, rk, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY) - epoch_us(max(ts)) > 36000000000 AS stale FROM r GROUP BY user_id, day, rk),
c AS (SELECT r.*, stale FROM r JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY stale, rk) = 1) b USING (user_id, day, rk))
SELECT user_id, day, event_id, value, CAST(rk AS INTEGER) AS source_rank, CASE WHEN stale THEN 'STALE' ELSE 'OK' END AS status FROM c""")
def pick_source(spark, d):
    rank = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = events(spark, d).where(F.col("event_type") != "error").select(
        "user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value", rank.alias("source_rank")
    )
    out = tb.pick_source(e, ["user_id", "day"], "ts", ["event_id"], F.date_add("day", 1).cast("timestamp"), 36_000)
    return out.select("user_id", "day", "event_id", "value", "source_rank", "status")


@query("refresh_difference", "G2 G1", """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'ADDED' AS change FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'REMOVED' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def refresh_difference(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return tb.refresh_difference(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O"), "k")


@query("key_overlap", "G3", """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def key_overlap(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where(F.col("o_orderstatus") == "F").select("k").intersect(o.where(F.col("o_orderstatus") == "P").select("k"))


@query("missing_targets", "C8 A9", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)")
def missing_targets(spark, d):
    seen = orders(spark, d).where(F.col("o_totalprice") >= 400000).select(F.col("o_custkey").alias("k"))
    return tb.missing_targets(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), seen, ["k"])


@query("eligible_rows", "C8 A3 B47", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def eligible_rows(spark, d):
    keys = orders(spark, d).where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(keys, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("fact_dimension_join", "C7", f"""WITH {DAILY} SELECT t.station, t.day, t.official, p.n AS prior_n, {six('p.high')} AS prior_high, {six('t.official - t.forecast')} AS err
FROM daily t JOIN daily p ON p.station = t.station AND p.day = t.day - 1""")
def fact_dimension_join(spark, d):
    t = daily(spark, d)
    prior = t.select("station", F.date_add("day", 1).alias("day"), F.col("n").alias("prior_n"), F.col("high").alias("prior_high"))
    out = t.join(prior, ["station", "day"]).withColumn("err", F.col("official") - F.col("forecast"))
    return tidy(out.select("station", "day", "official", "prior_n", "prior_high", "err"), "prior_high", "err")


@query("basis_flips", "B10 B11 B12 C7", f"""WITH {DAILY}, c AS (SELECT station, day, shape, high, official, CASE WHEN shape = 'below' THEN NULL ELSE floor(high) - 1 END AS lower,
 CASE WHEN shape = 'above' THEN NULL ELSE floor(high) + 1 END AS upper FROM daily, (SELECT unnest(['below', 'bucket', 'above']) AS shape)),
w AS (SELECT *, CASE shape WHEN 'below' THEN official < upper WHEN 'above' THEN official > lower ELSE official BETWEEN lower AND upper END AS off,
 CASE shape WHEN 'below' THEN high < upper WHEN 'above' THEN high > lower ELSE high BETWEEN lower AND upper END AS obs,
 CASE shape WHEN 'below' THEN official <= upper WHEN 'above' THEN official >= lower ELSE official BETWEEN lower AND upper END AS inc FROM c)
SELECT station, day, shape, off AS official_winner, obs AS observed_winner, off <> obs AS flip, inc AS inclusive_winner,
 {six('least(abs(official - lower), abs(official - upper))')} AS distance FROM w""")
def basis_flips(spark, d):
    out = flip_rows(spark, d)
    return tidy(out.select("station", "day", "shape", "official_winner", "observed_winner", "flip", "inclusive_winner", "distance"), "distance")


def flip_rows(spark, d):
    low, up = F.floor("high").cast("double") - 1, F.floor("high").cast("double") + 1
    c = daily(spark, d).withColumn("shape", F.explode(F.array(*[F.lit(s) for s in ("below", "bucket", "above")])))
    c = c.withColumns({"lower": F.when(F.col("shape") != "below", low), "upper": F.when(F.col("shape") != "above", up)})
    bounds = (F.col("shape"), F.col("lower"), F.col("upper"))
    won = contains(*bounds, F.col("official"))
    seen = contains(*bounds, F.col("high"))
    return c.withColumns({
        "official_winner": won, "observed_winner": seen, "flip": flips(won, seen),
        "inclusive_winner": contains(*bounds, F.col("official"), inclusive=True),
        "distance": boundary_distance(F.col("lower"), F.col("upper"), F.col("official")),
    })


@query("flip_overlay", "C9 E2 B16", f"""WITH {DAILY}, bk AS (SELECT user_id AS station, day, q.seq, yes_ask, size FROM (SELECT user_id, event_id AS seq, round(round(0.02 + k * 0.0094::DOUBLE, 4) + 0.03, 4) AS yes_ask,
 CAST(floor(value + 1) AS DOUBLE) AS size FROM ev) q JOIN obs ON obs.seq = q.seq),
fl AS (SELECT station, day, official < floor(high) + 1 AS off FROM daily WHERE (official < floor(high) + 1) <> (high < floor(high) + 1)),
wk AS (SELECT b.seq, b.station, b.day, f.off, dp, least(dp, size) AS t1, least(greatest(0, dp - size), size * 2) AS t2, yes_ask AS p1, yes_ask + 0.01::DOUBLE AS p2 FROM bk b JOIN fl f USING (station, day), (SELECT unnest([5.0, 50.0])::DOUBLE AS dp)),
pv AS (SELECT *, t1 + t2 AS filled, (t1 * p1 + t2 * p2) / (t1 + t2) AS vwap FROM wk)
SELECT seq, station, day, off AS official_winner, {six('max(vwap) FILTER (dp = 5)')} AS vwap_5, {six('max(vwap) FILTER (dp = 50)')} AS vwap_50, bool_or(filled >= dp) FILTER (dp = 50) AS complete_50,
 {two('max(filled * (off::INT - vwap) - filled * 0.07::DOUBLE * vwap * (1 - vwap)) FILTER (dp = 50)')} AS net_50 FROM pv GROUP BY ALL""")
def flip_overlay(spark, d):
    flipped = flip_rows(spark, d).where((F.col("shape") == "below") & F.col("flip")).select("station", "day", "official_winner")
    q = quotes(spark, d).select("seq", "yes_ask", "size").join(observations(spark, d).select("seq", "station", "day"), "seq")
    level = F.array(
        F.struct(F.col("yes_ask").alias("price"), F.col("size").alias("size")),
        F.struct((F.col("yes_ask") + 0.01).alias("price"), (F.col("size") * 2).alias("size")),
    )
    both = q.join(flipped, ["station", "day"]).withColumn("levels", level)
    for depth in (5, 50):
        both = both.withColumn(f"_d{depth}", books.executable_buy(F.col("levels"), F.lit(float(depth))))
    filled, vwap = F.col("_d50.filled"), F.col("_d50.vwap")
    net = filled * (F.col("official_winner").cast("double") - vwap) - fee_unrounded(F.lit(0.07), filled, vwap)
    return both.select(
        "seq", "station", "day", "official_winner", r6(F.col("_d5.vwap")).alias("vwap_5"), r6(vwap).alias("vwap_50"),
        F.col("_d50.complete").alias("complete_50"), r2(net).alias("net_50"),
    )


@query("pair_edge", "C10", f"""WITH q AS (SELECT l_partkey AS event, l_suppkey % 6 AS venue, 0.3::DOUBLE + 2 * l_discount + 0.01::DOUBLE AS y, 0.75::DOUBLE - l_tax * 4 + 0.01::DOUBLE AS n FROM lineitem),
b AS (SELECT event, venue, min(y) AS y, min(n) AS n FROM q GROUP BY ALL)
SELECT a.event AS event_id, a.venue AS yes_venue, c.venue AS no_venue, {six('1 - a.y - c.n')} AS locked_edge FROM b a JOIN b c ON a.event = c.event AND a.venue <> c.venue""")
def pair_edge(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("event_id"), (F.col("l_suppkey") % 6).alias("venue"),
        (F.lit(0.3) + 2 * F.col("l_discount") + 0.01).alias("yes_all_in"), (F.lit(0.75) - F.col("l_tax") * 4 + 0.01).alias("no_all_in"),
    )
    return tidy(ladders.locked_pairs(li).select("event_id", "yes_venue", "no_venue", "locked_edge"), "locked_edge")


@query("venue_rank", "F6", f"""WITH b AS (SELECT l_suppkey AS venue, avg(l_discount) AS m, min(0.4::DOUBLE + l_discount + l_tax / 2) AS cost FROM lineitem GROUP BY 1)
SELECT venue, {six('0.6::DOUBLE - cost')} AS edge, CAST(rank() OVER (ORDER BY round(0.6::DOUBLE - cost, 9) DESC) AS BIGINT) AS place FROM b""")
def venue_rank(spark, d):
    from marketlens.operators.ordered import running

    costs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("venue")).agg(F.min(F.lit(0.4) + F.col("l_discount") + F.col("l_tax") / 2).alias("cost"))
    edges = costs.select("venue", (F.lit(0.6) - F.col("cost")).alias("edge")).withColumn("_v", F.round("edge", 9))
    # The rank is one more than the venues above: equal edges are counted first and summed in value blocks.
    counted = edges.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    above = running(counted, ["_all"], ["_v"], {"_above": ("sum", F.col("_n"))}, F.floor(F.col("_v") * 100), descending=True, current=False)
    ranked = edges.join(above.select("_v", F.coalesce("_above", F.lit(0)).alias("_above")), "_v")
    return ranked.select("venue", r6(F.col("edge")).alias("edge"), (F.col("_above") + 1).cast("bigint").alias("place"))


@query("gate_events", "C14 I10", """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day FROM e GROUP BY ALL
 HAVING bool_and(epoch_us(ts) <= epoch_us(CAST(day AS TIMESTAMP)) + 72000000000 AND event_type <> 'error'))
SELECT e.event_id, e.user_id, e.day FROM e JOIN g USING (user_id, day)""")
def gate_events(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts")).withColumn("event", F.struct("user_id", "day"))
    now = F.date_add("day", 1).cast("timestamp")
    old_enough = F.unix_micros(now) - F.unix_micros("ts") >= F.lit(4 * 3_600_000_000)
    ok = feeds.fresh(F.col("ts"), now, 86_400) & old_enough & (F.col("event_type") != "error")
    return tb.gate_events(e, "event", ok).select("event_id", "user_id", "day")


@query("fee_schedule", "C16 B16", f"""WITH s(venue, series, rate, ok) AS (SELECT DISTINCT p_brand, CASE WHEN p_size > 25 THEN p_type END, 0.05::DOUBLE + p_size % 3 * 0.01::DOUBLE, p_size % 3 <> 2 FROM part
 QUALIFY row_number() OVER (PARTITION BY p_brand, CASE WHEN p_size > 25 THEN p_type END ORDER BY p_partkey) = 1),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT f.*, CASE WHEN e.venue IS NOT NULL THEN e.rate ELSE g.rate END AS rate, CASE WHEN e.venue IS NOT NULL THEN e.ok ELSE g.ok END AS ok FROM f
 LEFT JOIN s e ON e.venue = p_brand AND e.series = p_type LEFT JOIN s g ON g.venue = p_brand AND g.series IS NULL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {six('l_quantity * rate * (0.05::DOUBLE + 9 * l_discount) * (1 - (0.05::DOUBLE + 9 * l_discount))')} AS fee FROM j WHERE ok""")
def fee_schedule(spark, d):
    part = table(spark, d, "part")
    keyed = part.select(
        F.col("p_brand").alias("venue"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("series"),
        (F.lit(0.05) + F.col("p_size") % 3 * 0.01).alias("rate"), (F.col("p_size") % 3 != 2).alias("verified"), "p_partkey",
    )
    schedule = latest_per_key(keyed, ["venue", "series"], ["p_partkey"], first=True).drop("p_partkey")
    facts = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("venue"), F.col("p_type").alias("series"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"
    )
    good, _ = fee_rates(facts, schedule)
    fee = fee_unrounded(F.col("fee_rate"), F.col("l_quantity"), F.lit(0.05) + 9 * F.col("l_discount"))
    return good.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(fee).alias("fee"))


@query("parameter_grid", "C17", """SELECT o_orderkey, CAST(lat AS BIGINT) AS latency, dp AS depth, fl AS floor FROM orders, (SELECT unnest([0, 300]) AS lat), (SELECT unnest([5.0, 25.0])::DOUBLE AS dp),
 (SELECT unnest([0.0, 0.15])::DOUBLE AS fl)""")
def parameter_grid(spark, d):
    out = orders(spark, d).select("o_orderkey")
    out = out.withColumn("latency", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 300)])))
    out = out.withColumn("depth", F.explode(F.array(F.lit(5.0), F.lit(25.0))))
    return out.withColumn("floor", F.explode(F.array(F.lit(0.0), F.lit(0.15))))


@query("modal_basis", "D4", f"""WITH {OBS}, c AS (SELECT station, day, floor(temp / 20) * 20 AS v, count(*) AS n, min(seq) AS f FROM obs GROUP BY ALL),
m AS (SELECT station, day, arg_max(v, struct_pack(n := n, f := -f)) AS modal, count(*) AS vals FROM c GROUP BY ALL),
b AS (SELECT m.*, modal - h.high AS basis FROM m JOIN (SELECT station, day, max(temp) AS high FROM obs GROUP BY ALL) h USING (station, day))
SELECT station, count(*) AS days, count(*) FILTER (vals > 1) AS disagreements, {six('avg(basis)')} AS mean, {six('median(basis)')} AS median, {six('min(basis)')} AS low, {six('max(basis)')} AS high,
 count(*) FILTER (abs(basis) > 1) AS over_1, count(*) FILTER (abs(basis) > 2) AS over_2, {six('sqrt(avg(basis * basis))')} AS rmse FROM b GROUP BY station""")
def modal_basis(spark, d):
    from marketlens.operators.ordered import exact_quantiles

    o = observations(spark, d)
    modal = tb.modal_value(o.withColumn("v", F.floor(F.col("temp") / 20) * 20.0), ["station", "day"], "v", "seq")
    highs = o.groupBy("station", "day").agg(F.max("temp").alias("top"))
    b = modal.join(highs, ["station", "day"]).withColumn("basis", F.col("modal") - F.col("top"))
    out = b.groupBy("station").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("disagree").alias("disagreements"), F.avg("basis").alias("mean"),
        F.min("basis").alias("low"), F.max("basis").alias("high"), F.count_if(F.abs("basis") > 1).alias("over_1"),
        F.count_if(F.abs("basis") > 2).alias("over_2"), F.sqrt(F.avg(F.col("basis") * F.col("basis"))).alias("rmse"),
    ).join(exact_quantiles(b, ["station"], "basis", {"median": 0.5}, 1.0), "station")
    return tidy(out, "mean", "low", "high", "rmse", "median")


def messages(spark, d):
    """Events as numbered stream messages of one connection per user, with breaks and repeats."""
    e = events(spark, d)
    kept = e.withColumns({"connection": F.col("user_id"), "sid": F.when(F.col("k") != 98, F.lit(1)), "pos": F.col("event_id")})
    placed = ordinal(kept, ["connection"], ["ts", "event_id"], "_n", time_block("ts"))
    k = F.col("k")
    seq = F.when(k == 7, F.col("_n") - 2).when(k == 50, F.col("_n") + 3).when(k != 97, F.col("_n"))
    return placed.select(
        "connection", "sid", seq.alias("seq"), F.col("event_type").isin("signup", "click").alias("is_book"), "ts", "pos", "event_type", "value"
    )


MSG = EVENTS + """, msg AS (SELECT user_id AS connection, CASE WHEN k <> 98 THEN 1 END AS sid, CASE WHEN k = 7 THEN n - 2 WHEN k = 50 THEN n + 3 WHEN k <> 97 THEN n END AS seq,
 event_type IN ('signup', 'click') AS is_book, ts, event_id AS pos, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev)),
jd AS (SELECT *, CASE WHEN sid IS NULL OR seq IS NULL THEN CASE WHEN is_book THEN 'GAP' ELSE 'UNSEQUENCED' END WHEN b IS NULL THEN 'APPLIED' WHEN seq <= b THEN 'DUPLICATE' WHEN seq > b + 1 THEN 'GAP' ELSE 'APPLIED' END AS raw
 FROM (SELECT *, max(seq) OVER (PARTITION BY connection, sid ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM msg)),
sq AS (SELECT j.*, CASE WHEN g.g IS NOT NULL AND struct_pack(t := ts, p := pos) > g.g THEN 'INVALIDATED' ELSE raw END AS status FROM jd j LEFT JOIN
 (SELECT connection, min(struct_pack(t := ts, p := pos)) AS g FROM jd WHERE raw = 'GAP' GROUP BY 1) g USING (connection)),
sc AS (SELECT *, CASE WHEN status = 'GAP' AND sid IS NOT NULL AND seq IS NOT NULL THEN seq - b - 1 ELSE 0 END AS missing FROM sq)"""


@query("sequence_status", "I2", f"WITH {MSG} SELECT connection, pos, seq, status, missing FROM sc")
def sequence_status(spark, d):
    return feeds.sequence_status(messages(spark, d)).select("connection", "pos", "seq", "status", "missing")


@query("best_quotes", "I3 A12", f"""WITH {QUOTES} SELECT contract, arg_max(seq, struct_pack(t := ts, s := seq)) AS seq, {six('arg_max(yes_bid, struct_pack(t := ts, s := seq))')} AS yes_bid,
 {six('1 - arg_max(yes_ask, struct_pack(t := ts, s := seq))')} AS no_bid, arg_max(CASE WHEN event_type = 'purchase' THEN value END, struct_pack(t := ts, s := seq)) FILTER (event_type = 'purchase') AS last_trade FROM quotes GROUP BY contract""")
def best_quotes(spark, d):
    q = quotes(spark, d).withColumn("last_trade", F.when(F.col("event_type") == "purchase", F.col("value")))
    out = feeds.best_quotes(q, "contract", ["ts", "seq"], ["last_trade"]).withColumns({"yes_ask_size": F.col("size"), "yes_bid_size": F.col("size")})
    return tidy(feeds.complement_quote(out).select("contract", "seq", "yes_bid", "no_bid", "last_trade"), "yes_bid", "no_bid")


@query("type_counts", "I5 I15", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY ALL")
def type_counts(spark, d):
    out = feeds.type_counts(events(spark, d), "ts", "event_type")
    return out.withColumns({c: naive(F.col(c)) for c in ("window_start", "last_seen")})


@query("sliding_counts", "I15", """SELECT user_id, CAST(h AS TIMESTAMP) AS window_start, count(*) AS n FROM (SELECT user_id, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS h FROM events) GROUP BY ALL""")
def sliding_counts(spark, d):
    out = events(spark, d).groupBy("user_id", F.window("ts", "3 hours", "1 hour").alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", naive(F.col("_w.start")).alias("window_start"), "n")


@query("health_transitions", "I12", """WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'STALE_HEALTH' WHEN 'purchase' THEN 'INVALID_HEALTH_TTL' ELSE '' END AS sig FROM events),
l AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS old FROM s)
SELECT user_id, event_id, CASE WHEN sig = '' THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN old = '' THEN 'OK' ELSE 'ERROR' END AS previous_status, old AS previous_reason FROM l WHERE sig <> old""")
def health_transitions(spark, d):
    e = events(spark, d).withColumns({
        "reported": F.when(F.col("event_type") != "error", F.col("ts")).otherwise(F.date_sub("ts", 2).cast("timestamp")),
        "ttl": F.when(F.col("event_type") != "purchase", F.lit(3600.0)), "error": F.lit(None).cast("string"),
    })
    judged = feeds.assess_health(e, stamp="reported", error="error", now=F.col("ts"), limit=F.col("ttl"))
    out = feeds.health_transitions(judged, "user_id", "ts", ["event_id"])
    return out.select("user_id", "event_id", "status", "previous_status", "previous_reason")


@query("compare_cycles", "I16", """WITH h AS (SELECT o_orderkey AS cycle, o_orderdate AS stamp, CAST(o_totalprice / 100000 AS BIGINT) AS n FROM orders),
c AS (SELECT l_orderkey AS cycle, count(*) AS n FROM lineitem GROUP BY 1)
SELECT h.cycle, concat_ws(',', CASE WHEN c.cycle IS NULL THEN 'missing_current' END, CASE WHEN h.stamp <= TIMESTAMP '1996-01-01' THEN 'no_new_successful_cycle' END, CASE WHEN h.n <> c.n THEN 'count_mismatch_n' END) AS errors FROM h LEFT JOIN c USING (cycle)""")
def compare_cycles(spark, d):
    o = orders(spark, d)
    left = o.select(F.col("o_orderkey").alias("cycle"), F.col("o_orderdate").alias("stamp"), F.rint(F.col("o_totalprice") / 100000).cast("bigint").alias("n"))
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cycle")).agg(F.count(F.lit(1)).alias("n"))
    right = counts.join(left.select("cycle", "stamp"), "cycle")
    out = feeds.compare_cycles(left, right, "cycle", ["n"], after=F.lit("1996-01-01").cast("timestamp"), stamp="stamp")
    return out.select("cycle", F.array_join("errors", ",").alias("errors"))


@query("quote_normalise", "B13 B14", f"""WITH {QUOTES} SELECT seq, {six("CASE WHEN k % 2 = 0 THEN yes_bid ELSE CAST(k AS BIGINT) / 100.0::DOUBLE END")} AS bid, {six("1 - CASE WHEN k % 2 = 0 THEN yes_bid ELSE CAST(k AS BIGINT) / 100.0::DOUBLE END")} AS other_ask FROM quotes""")
def quote_normalise(spark, d):
    q = quotes(spark, d).withColumn("bid", quote_dollars(F.when(F.col("k") % 2 == 0, F.col("yes_bid")), F.col("k")))
    return tidy(q.select("seq", "bid", (1 - F.col("bid")).alias("other_ask")), "bid", "other_ask")


@query("legacy_migration", "A20", """WITH s AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS time, CASE WHEN event_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS side, CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN 'B' ELSE 'C' END AS track, event_id FROM events),
t AS (SELECT *, CASE track WHEN 'A' THEN 'strategy_a' WHEN 'B' THEN 'strategy_b' END AS strategy FROM s),
sig AS (SELECT DISTINCT strategy, ticker, time, side, strategy || '/' || ticker || '/' || time || '/' || side AS signal_id FROM t WHERE strategy IS NOT NULL)
SELECT f.event_id, f.strategy, sig.signal_id FROM t f JOIN sig USING (strategy, ticker, time, side) JOIN events e ON e.event_id = f.event_id WHERE e.value >= 30""")
def legacy_migration(spark, d):
    e = events(spark, d)
    track = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "view", "B").otherwise("C")
    rows = e.select(
        F.col("user_id").alias("ticker"), F.to_date("ts").alias("time"), F.when(F.col("event_id") % 2 == 0, "YES").otherwise("NO").alias("side"),
        track.alias("track"), "event_id", "value",
    )
    named = F.when(F.col("track") == "A", "strategy_a").when(F.col("track") == "B", "strategy_b")
    signals = rows.withColumns({"status": F.lit("SIGNAL"), "signal_id": F.concat_ws("/", named, "ticker", "time", "side")})
    fills = rows.withColumn("status", F.when(F.col("value") >= 30, "PAPER_FILLED").otherwise("NO_FILL"))
    out = tb.migrate_log(signals, fills, {"A": "strategy_a", "B": "strategy_b"})
    return out.select("event_id", "strategy", "signal_id")
