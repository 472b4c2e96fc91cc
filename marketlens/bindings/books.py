"""Book reconstruction, as-of pricing and settlement on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.evaluation import INTERVAL, VERDICT, draws_sql
from marketlens.bindings.registry import query
from marketlens.bindings.views import EVENTS, QUOTES, events, quotes, six, two
from marketlens.functions.numbers import fee_ceil_cent
from marketlens.functions.numbers import six as r6
from marketlens.functions.numbers import two as r2
from marketlens.functions.times import naive
from marketlens.operators import books, pricing
from marketlens.operators import evaluate as ev
from marketlens.session import cut_lineage
from marketlens.operators.asof import asof_backward, asof_forward

DAY = 86_400
LEVEL = "array<struct<price:double,size:double>>"


def depth_log(spark, d):
    return depth_log_of(events(spark, d))


def depth_log_of(e):
    """Events as a snapshot/delta log: signup is a snapshot, view an unknown kind, the rest deltas."""
    price = (F.col("k") % 9 + 1) / 10.0
    snap = F.col("event_type") == "signup"
    amount = F.floor("value").cast("double")
    signed = F.when(F.col("event_type") == "error", -amount).when(F.col("event_type") == "purchase", F.floor(amount / 2)).otherwise(amount)
    yes = F.array(
        F.struct(price.alias("price"), (amount + 1).alias("size")), F.struct(F.lit(0.05).alias("price"), F.lit(10.0).alias("size"))
    )
    no = F.array(
        F.struct(F.lit(0.05).alias("price"), (amount + 5).alias("size")),
        F.struct(F.lit(0.15).alias("price"), F.lit(0.0).alias("size")),
    )
    kind = F.when(snap, "orderbook_snapshot").when(F.col("event_type") == "view", "ticker").otherwise("orderbook_delta")
    return e.select(
        F.col("user_id").alias("ticker"), "ts", F.col("ts").alias("received"), F.col("event_id").alias("seq"),
        kind.alias("event_type"), F.when(snap, yes.cast(LEVEL)).alias("yes_bids"), F.when(snap, no.cast(LEVEL)).alias("no_bids"),
        F.when(~snap & (F.col("event_type") != "view"), price).alias("price"),
        F.when(~snap & (F.col("event_type") != "view"), signed.cast("double")).alias("delta"),
        F.when(F.col("k") % 2 == 0, "yes").otherwise("no").alias("side"),
    )


LOG = EVENTS + """, log AS (SELECT user_id AS ticker, ts, event_id AS seq, event_type AS kind, (k % 9 + 1) / 10.0::DOUBLE AS price,
 CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS side, floor(value) AS amount,
 sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ev),
chg AS (SELECT ticker, ts, seq, epoch, side, price, CASE kind WHEN 'error' THEN -amount WHEN 'purchase' THEN floor(amount / 2)
 ELSE amount END AS change FROM log WHERE kind IN ('click', 'error', 'purchase') AND epoch > 0
 UNION ALL SELECT ticker, ts, seq, epoch, 'yes', price, amount + 1 FROM log WHERE kind = 'signup'
 UNION ALL SELECT ticker, ts, seq, epoch, 'yes', 0.05, 10 FROM log WHERE kind = 'signup'
 UNION ALL SELECT ticker, ts, seq, epoch, 'no', 0.05, amount + 5 FROM log WHERE kind = 'signup'),
run AS (SELECT *, sum(change) OVER w AS c FROM chg WINDOW w AS (PARTITION BY ticker, epoch, side, price ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT ticker, ts, seq, epoch, side, price, c - least(0, min(c) OVER (PARTITION BY ticker, epoch, side, price ORDER BY ts, seq
 ROWS UNBOUNDED PRECEDING)) AS size FROM run)"""


@query("level_changes", "E1 A2", f"WITH {LOG} SELECT ticker, CAST(epoch AS BIGINT) AS epoch, side, price, seq, size FROM lev")
def level_changes(spark, d):
    return books.level_changes(depth_log(spark, d)).select("ticker", "epoch", "side", "price", "seq", "size")


def absolute_log(spark, d):
    log = depth_log(spark, d)
    return log.withColumn("size", F.abs("delta")).withColumn(
        "event_type", F.when(F.col("event_type") == "orderbook_snapshot", "book")
        .when(F.col("event_type") == "orderbook_delta", "price_change").otherwise("other"),
    ).withColumn("size", F.when(F.col("delta") < 0, 0.0).otherwise(F.col("size")))


@query("absolute_levels", "E3", f"""WITH {LOG}, a AS (SELECT ticker, ts, seq, epoch, side, price, greatest(0, change) AS size FROM chg)
SELECT ticker, CAST(epoch AS BIGINT) AS epoch, side, price, arg_max(size, seq) AS last_size, count(*) AS changes,
 count(*) FILTER (size <= 0) AS removals FROM a GROUP BY ticker, epoch, side, price""")
def absolute_levels(spark, d):
    out = books.absolute_level_changes(absolute_log(spark, d))
    return out.groupBy("ticker", "epoch", "side", "price").agg(
        F.max_by("size", "seq").alias("last_size"), F.count(F.lit(1)).alias("changes"),
        F.count_if(F.col("size") <= 0).alias("removals"),
    )


BOOK = LOG + """, tgt AS (SELECT ticker, ts AS at, seq AS target, epoch FROM log WHERE kind = 'view' AND epoch > 0),
live AS (SELECT t.ticker, t.target, l.side, l.price, arg_max(l.size, struct_pack(a := l.ts, b := l.seq)) AS size
 FROM tgt t JOIN lev l ON l.ticker = t.ticker AND l.epoch = t.epoch AND l.ts <= t.at GROUP BY ALL HAVING size > 0)"""


def live_levels(spark, d):
    log = depth_log(spark, d)
    numbered = cut_lineage(books.with_epoch(log, F.col("event_type") == "orderbook_snapshot"))
    changes = cut_lineage(books.level_changes(log, epochs=numbered))
    epochs = numbered.where(F.col("event_type") == "orderbook_snapshot").select("ticker", "ts", "seq", "epoch")
    targets = log.where(F.col("event_type") == "ticker").select("ticker", F.col("ts").alias("at"), F.col("seq").alias("target"))
    return books.book_at(changes, epochs, targets, ["ticker", "target"], "at")


@query("book_at", "E1 C1 B13", f"""WITH {BOOK} SELECT ticker, target, max(price) FILTER (side = 'yes') AS yes_bid,
 max(price) FILTER (side = 'no') AS no_bid, arg_max(size, price) FILTER (side = 'yes') AS yes_bid_size,
 arg_max(size, price) FILTER (side = 'no') AS no_bid_size, {six("1 - max(price) FILTER (side = 'no')")} AS yes_ask,
 {six("1 - max(price) FILTER (side = 'yes')")} AS no_ask,
 {six("1 - max(price) FILTER (side = 'no') - max(price) FILTER (side = 'yes')")} AS spread FROM live GROUP BY ticker, target""")
def book_at(spark, d):
    out = books.top_of_book(live_levels(spark, d), ["ticker", "target"])
    return out.withColumns({c: r6(F.col(c)) for c in ("yes_ask", "no_ask", "spread")})


@query("top_levels", "E16", f"""WITH {BOOK}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, target, side ORDER BY price DESC) AS r FROM live)
SELECT ticker, target, side, sum(size) AS depth_top5, count(*) AS levels, max(price) AS best,
 string_agg(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY price DESC) AS ladder
FROM r WHERE r <= 5 GROUP BY ticker, target, side""")
def top_levels(spark, d):
    top = books.top_levels(live_levels(spark, d), ["ticker", "target", "side"], "price", "size", 5)
    cents = F.transform(
        F.array_sort(F.collect_list("level_row")), lambda x: F.round(x["price"] * 100).cast("bigint").cast("string")
    )
    return top.withColumn("level_row", F.struct("level", "price")).groupBy("ticker", "target", "side").agg(
        F.sum("size").alias("depth_top5"), F.count(F.lit(1)).alias("levels"), F.max("price").alias("best"),
        F.array_join(cents, ",").alias("ladder"),
    )


@query("asof_backward", "C1", """SELECT l.event_id, l.user_id, r.event_id AS seen_id, r.ts AS seen_ts, r.value AS seen_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r
 ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward_query(spark, d):
    e = events(spark, d)
    right = e.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("seen_ts"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value")
    )
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    out = asof_backward(left, right, ["user_id"], "ts", "seen_ts", ["seen_id", "seen_ts", "seen_value"], right_tie=["seen_id"])
    return out.select("event_id", "user_id", "seen_id", naive(F.col("seen_ts")).alias("seen_ts"), "seen_value")


@query("asof_forward_latency", "C2 C3 C17", """WITH l AS (SELECT *, ts + to_seconds(latency) AS due FROM events,
 (SELECT unnest([0, 3600, 86400]) AS latency) WHERE event_type = 'purchase'),
m AS (SELECT l.event_id, l.latency, l.due, min(struct_pack(t := r.ts, e := r.event_id)) AS h FROM l LEFT JOIN events r
 ON r.user_id = l.user_id AND r.event_type = 'view' AND r.ts >= l.due GROUP BY ALL)
SELECT event_id, CAST(latency AS BIGINT) AS latency, CASE WHEN h.t <= due + INTERVAL 2 DAY THEN h.e END AS quote_id,
 CASE WHEN h.t <= due + INTERVAL 2 DAY THEN h.t END AS quote_ts FROM m""")
def asof_forward_latency(spark, d):
    e = events(spark, d)
    right = e.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("quote_ts"), F.col("event_id").alias("quote_id")
    )
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts").withColumn(
        "latency", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 3600, DAY)]))
    )
    out = asof_forward(
        left, right, ["user_id"], "ts", "quote_ts", ["quote_id", "quote_ts"], right_tie=["quote_id"],
        latency=F.col("latency"), tolerance_seconds=2 * DAY,
    )
    return out.select("event_id", "latency", "quote_id", naive(F.col("quote_ts")).alias("quote_ts"))


def signals(spark, d):
    """Signup events as signals of two strategies."""
    q = quotes(spark, d).where(F.col("event_type") == "signup")
    return q.select(
        F.col("seq").alias("signal_id"), "contract", F.col("ts").alias("signal_time"),
        F.when(F.col("k") % 2 == 0, "YES").otherwise("NO").alias("side"),
        F.when(F.col("k") % 3 == 0, "alpha").otherwise("beta").alias("strategy"), F.to_date("ts").alias("date"),
        F.concat(F.lit("S"), (F.col("contract") % 10).cast("string")).alias("station"),
    )


SIG = QUOTES + """, sig AS (SELECT seq AS signal_id, contract, ts AS signal_time, CASE WHEN k % 2 = 0 THEN 'YES' ELSE 'NO' END AS side,
 CASE WHEN k % 3 = 0 THEN 'alpha' ELSE 'beta' END AS strategy, CAST(ts AS DATE) AS date, 'S' || CAST(contract % 10 AS VARCHAR) AS station
 FROM quotes WHERE event_type = 'signup'),
book AS (SELECT * FROM quotes WHERE event_type <> 'signup')"""


def market(spark, d):
    return quotes(spark, d).where(F.col("event_type") != "signup")


def fee_function(price, contracts):
    return fee_ceil_cent(0.07, contracts, price).cast("double")


def fills(spark, d):
    return pricing.delayed_fills(
        signals(spark, d), market(spark, d), latency=F.lit(3600), contracts=20, slippage=0.005, stress_ticks=1,
        fee=fee_function,
    )


FILLS = SIG + """, m AS (SELECT s.*, min(struct_pack(t := b.ts, e := b.seq)) AS h FROM sig s LEFT JOIN book b
 ON b.contract = s.contract AND b.ts >= s.signal_time + INTERVAL 1 HOUR GROUP BY ALL),
f0 AS (SELECT m.*, b.ts AS fill_time, CASE WHEN b.ts IS NULL THEN 'NO_MARKET_QUOTE' ELSE 'FILLED' END AS status,
 least(20, CAST(floor(b.size) AS BIGINT)) AS quantity,
 least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, CASE WHEN side = 'YES' THEN b.yes_ask ELSE b.no_ask END + 0.015::DOUBLE)) AS price
 FROM m LEFT JOIN book b ON b.contract = m.contract AND b.seq = m.h.e),
fills AS (SELECT * REPLACE (CASE WHEN fill_time IS NOT NULL THEN quantity END AS quantity, CASE WHEN fill_time IS NOT NULL THEN price END AS price),
 CASE WHEN fill_time IS NOT NULL THEN CAST(ceil(0.07::DECIMAL(5,4) * quantity::DECIMAL(10,2) * price::DECIMAL(9,6)
 * (1::DECIMAL(1,0) - price::DECIMAL(9,6)) * 100::DECIMAL(3,0)) AS DOUBLE) / 100 END AS fee FROM f0)"""


@query("delayed_fill", "H16 C2 I6 J2 B15", f"""WITH {FILLS} SELECT signal_id, side, status, fill_time, quantity, {six('price')} AS price,
 {six('fee')} AS fee FROM fills""")
def delayed_fill(spark, d):
    return fills(spark, d).select(
        "signal_id", "side", "status", naive(F.col("fill_time")).alias("fill_time"), "quantity",
        r6(F.col("price")).alias("price"), r6(F.col("fee")).alias("fee"),
    )


HORIZONS = (0, 3600, 21_600, 86_400)
MARKS = """mk AS (SELECT s.signal_id, s.side, CAST(hz AS BIGINT) AS horizon, s.signal_time + to_seconds(hz) AS due,
 min(struct_pack(t := b.ts, e := b.seq)) AS h FROM sig s, (SELECT unnest([0, 3600, 21600, 86400]) AS hz) JOIN book b
 ON b.contract = s.contract AND b.ts >= s.signal_time + to_seconds(hz) GROUP BY ALL),
marks AS (SELECT mk.signal_id, mk.horizon, CASE WHEN mk.side = 'YES' THEN b.yes_bid ELSE b.no_bid END AS value,
 (epoch_us(b.ts) - epoch_us(mk.due)) / 1e6 AS delay FROM mk JOIN book b ON b.seq = mk.h.e)"""


def marks(spark, d):
    return pricing.markouts(signals(spark, d), market(spark, d), HORIZONS)


@query("markouts", "I7 C2", f"WITH {SIG}, {MARKS} SELECT signal_id, horizon, {six('value')} AS value, {six('delay')} AS delay_seconds FROM marks")
def markouts(spark, d):
    return marks(spark, d).select(
        "signal_id", "horizon", r6(F.col("value")).alias("value"), r6(F.col("delay_seconds")).alias("delay_seconds")
    )


@query("mean_markout", "D33", f"""WITH {FILLS}, {MARKS} SELECT horizon, count(*) AS marks, {six('avg(value - price)')} AS markout
FROM marks JOIN fills USING (signal_id) WHERE price IS NOT NULL GROUP BY horizon""")
def mean_markout(spark, d):
    filled = fills(spark, d).where(F.col("status") == "FILLED").select("signal_id", "price")
    return ev.mean_markouts(marks(spark, d).select("signal_id", "horizon", "value"), filled).withColumn("markout", r6(F.col("markout")))


def results(spark, d):
    """Settlement of a contract: yes when its last event is a purchase or a click."""
    last = events(spark, d).groupBy(F.col("user_id").alias("contract")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("_t")
    )
    return last.select("contract", F.when(F.col("_t").isin("purchase", "click"), "YES").otherwise("NO").alias("result"))


SETTLED = FILLS + """, res AS (SELECT user_id AS contract, CASE WHEN arg_max(event_type, struct_pack(t := ts, e := event_id))
 IN ('purchase', 'click') THEN 'YES' ELSE 'NO' END AS result FROM ev GROUP BY user_id),
settled AS (SELECT f.*, r.result, f.side = r.result AS won, CASE WHEN f.side = r.result THEN quantity ELSE 0 END - quantity * price - fee AS pnl,
 quantity * price + fee AS capital FROM fills f JOIN res r USING (contract) WHERE status = 'FILLED')"""


def settled(spark, d):
    return pricing.settle(fills(spark, d).where(F.col("status") == "FILLED"), results(spark, d), ["contract"])


@query("settled_fills", "C18 B17 I11", f"""WITH {SETTLED} SELECT signal_id, contract, side, result, won, {six('pnl')} AS pnl,
 {six('capital')} AS capital, {six('pnl / capital')} AS roi FROM settled""")
def settled_fills(spark, d):
    return settled(spark, d).select(
        "signal_id", "contract", "side", "result", "won", r6(F.col("pnl")).alias("pnl"), r6(F.col("capital")).alias("capital"),
        r6(F.col("pnl") / F.col("capital")).alias("roi"),
    )


@query("fact_scorecard", "D17 G1", f"""WITH {SETTLED}, {MARKS},
names AS (SELECT strategy FROM sig UNION SELECT 'gamma' FROM (SELECT count(*) FROM quotes)),
evals AS (SELECT CASE WHEN k % 3 = 0 THEN 'alpha' WHEN k % 3 = 1 THEN 'beta' ELSE 'gamma' END AS strategy, count(*) AS evaluations
 FROM quotes GROUP BY 1),
sg AS (SELECT strategy, count(*) AS signals FROM sig GROUP BY 1),
fl AS (SELECT strategy, count(*) AS fills FROM fills WHERE status = 'FILLED' GROUP BY 1),
st AS (SELECT strategy, count(*) AS settled, count(*) FILTER (pnl > 0) AS wins, sum(pnl) AS net, sum(capital) AS capital,
 count(DISTINCT date) AS dates, count(DISTINCT station) AS stations FROM settled GROUP BY 1),
mo AS (SELECT strategy, avg(value - price) AS m FROM marks JOIN fills USING (signal_id) WHERE status = 'FILLED' AND horizon = 3600 GROUP BY 1),
evt AS (SELECT strategy, signal_id AS event, station, date, pnl, capital FROM settled),
perd AS (SELECT strategy, date, sum(pnl) AS pnl, sum(capital) AS capital FROM evt GROUP BY ALL), {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL},
dd AS (SELECT strategy, min(least(0, e - greatest(0, p))) AS fall FROM (SELECT strategy, e, max(e) OVER (PARTITION BY strategy ORDER BY fill_time, signal_id ROWS UNBOUNDED PRECEDING) AS p FROM
 (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY fill_time, signal_id ROWS UNBOUNDED PRECEDING) AS e FROM settled)) GROUP BY strategy), {VERDICT}
SELECT strategy, {six('coalesce(fall, 0)')} AS max_drawdown, coalesce(verdict, 'insufficient_data') AS verdict,
 CASE WHEN verdict IS NULL THEN 'no settled fills' WHEN verdict = 'insufficient_data' THEN 'need >= 30 events, >= 20 settlement dates, >= 2 stations for exploratory read'
 WHEN verdict = 'kill' THEN CASE WHEN v.net <= 0 OR mean_roi <= 0 THEN 'negative out-of-sample economics after realistic execution' ELSE '95% settlement-date block-bootstrap ROI interval is entirely non-positive' END
 WHEN verdict = 'provisional' THEN CASE WHEN v.dates < 50 THEN 'positive exploratory economics; need >= 50 independent settlement dates for KEEP' ELSE 'positive point estimate but date-block 95% ROI interval crosses zero' END
 ELSE 'positive OOS economics with positive date-block bootstrap lower bound and sufficient independent dates' END AS reason, evaluations, coalesce(signals, 0) AS signals, coalesce(fills, 0) AS fills, coalesce(settled, 0) AS settled,
 coalesce(st.wins, 0) AS wins, coalesce(settled, 0) - coalesce(st.wins, 0) AS losses, coalesce(st.dates, 0) AS dates,
 coalesce(st.stations, 0) AS stations, {six('coalesce(st.net, 0)')} AS net, {six('coalesce(st.capital, 0)')} AS capital,
 {six('st.net / st.capital')} AS roi, {six('m')} AS markout_3600
FROM names JOIN evals USING (strategy) LEFT JOIN sg USING (strategy) LEFT JOIN fl USING (strategy) LEFT JOIN st USING (strategy) LEFT JOIN mo USING (strategy) LEFT JOIN verdicts v USING (strategy)""")
def fact_scorecard(spark, d):
    q = quotes(spark, d)
    name = F.when(F.col("k") % 3 == 0, "alpha").when(F.col("k") % 3 == 1, "beta").otherwise("gamma")
    done = cut_lineage(fills(spark, d).where(F.col("status") == "FILLED"))
    filled = done.select(
        "signal_id", F.col("signal_id").alias("fill_id"), F.col("fill_time").alias("filled_at"), "price", F.col("quantity").alias("contracts"), "fee"
    )
    pnl = pricing.settle(done, results(spark, d), ["contract"]).select(F.col("signal_id").alias("fill_id"), "pnl")
    card = ev.scorecard(
        q.select(name.alias("strategy")), signals(spark, d).select("strategy", "signal_id", "date", "station"), filled, pnl,
        marks(spark, d).select("signal_id", "horizon", "value"),
    )
    return card.select(
        "strategy", "evaluations", "signals", "fills", "settled", "wins", "losses", "dates", "stations",
        r6(F.col("net")).alias("net"), r6(F.col("capital")).alias("capital"), r6(F.col("roi")).alias("roi"),
        r6(F.element_at("markouts", F.lit(3600).cast("bigint"))).alias("markout_3600"), r6(F.col("max_drawdown")).alias("max_drawdown"), "verdict", "reason",
    )


@query("threshold_cross_fill", "E13", f"""WITH {QUOTES}, r AS (SELECT *, CASE WHEN event_type = 'click' THEN CAST(value AS BIGINT) END AS raw FROM quotes),
q AS (SELECT contract, ts, seq, yes_ask AS ask, last_value(greatest(0, raw) IGNORE NULLS) OVER (PARTITION BY contract ORDER BY ts, seq
 ROWS UNBOUNDED PRECEDING) AS bps FROM r),
u AS (SELECT * FROM q WHERE ask > 0 AND ask <= 0.9),
t AS (SELECT contract, th AS threshold, min(ts) AS signal_time FROM u, (SELECT unnest([0.5, 0.7, 0.85])::DOUBLE AS th) WHERE ask >= th GROUP BY ALL),
a AS (SELECT t.*, CAST(l AS BIGINT) AS latency, min(struct_pack(t := u.ts, e := u.seq)) AS h FROM t, (SELECT unnest([0, 3600]) AS l) JOIN u
 ON u.contract = t.contract AND u.ts >= t.signal_time + to_seconds(l) GROUP BY ALL)
SELECT a.contract, a.threshold, a.latency, a.signal_time, u.ts AS fill_time, {six('u.ask')} AS price, {six('u.ask * coalesce(u.bps, 0) / 10000')} AS fee
FROM a JOIN u ON u.contract = a.contract AND u.seq = a.h.e""")
def threshold_cross_fill(spark, d):
    q = quotes(spark, d).withColumnRenamed("yes_ask", "ask").withColumn(
        "fee_bps", F.when(F.col("event_type") == "click", F.rint("value").cast("bigint"))
    )
    out = pricing.threshold_fills(q, "contract", [0.5, 0.7, 0.85], [0, 3600], cap=0.9)
    return out.select(
        "contract", "threshold", "latency", naive(F.col("signal_time")).alias("signal_time"),
        naive(F.col("fill_time")).alias("fill_time"), r6(F.col("price")).alias("price"), r6(F.col("fee")).alias("fee"),
    )
