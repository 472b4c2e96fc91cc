"""The flagship back-test and its parts on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.registry import query
from marketlens.bindings.views import LINES, book_lines, orders, six
from marketlens.functions.numbers import six as r6
from marketlens.operators.books import depth_vwap
from marketlens.operators.selection import first_per_event
from marketlens.plans.settlement_backtest import execute, summarize_cells

MONTH = 30 * 86_400
SIGNAL_PRICE = 150_000


def first_signals(spark, d):
    o = orders(spark, d).where(F.col("o_totalprice") >= SIGNAL_PRICE)
    first = first_per_event(o, ["o_custkey"], "o_orderdate", "o_totalprice", ["o_orderkey"])
    return first.select(
        F.col("o_custkey").alias("event"), F.col("o_orderdate").alias("signal_time"),
        (F.col("o_orderstatus") == "F").alias("won"), F.col("o_orderkey").alias("signal_key"),
    )


def trades(spark, d):
    books = orders(spark, d).select(
        F.col("o_custkey").alias("event"), F.col("o_orderdate").alias("book_time"), F.col("o_orderkey").alias("book")
    )
    return execute(
        first_signals(spark, d), books, book_lines(spark, d), latencies=[0, MONTH, 3 * MONTH], depths=[10, 50],
        fee_coefficient=0.07, block_seconds=MONTH,
    )


SIGNALS_SQL = f"""sig AS (SELECT o_custkey AS event, o_orderdate AS signal_time, o_orderstatus = 'F' AS won,
 o_orderkey AS signal_key FROM orders WHERE o_totalprice >= {SIGNAL_PRICE}
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) = 1)"""

TRADES_SQL = f"""{LINES}, {SIGNALS_SQL},
aimed AS (SELECT *, signal_time + to_seconds(CAST(latency AS BIGINT)) AS target FROM sig,
 (SELECT unnest([0.0, {MONTH}.0, {3 * MONTH}.0])::DOUBLE AS latency)),
found AS (SELECT a.*, (SELECT arg_min(o.o_orderkey, struct_pack(t := o.o_orderdate, k := o.o_orderkey)) FROM orders o
 WHERE o.o_custkey = a.event AND o.o_orderdate >= a.target) AS book FROM aimed a),
want AS (SELECT *, unnest([10.0, 50.0])::DOUBLE AS depth FROM found),
walk AS (SELECT w.event, w.latency, w.depth, l.price, l.size,
 coalesce(sum(l.size) OVER (PARTITION BY w.event, w.latency, w.depth ORDER BY l.price
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
 FROM want w JOIN (SELECT book, price, sum(size) AS size FROM lines GROUP BY 1, 2) l ON l.book = w.book),
priced AS (SELECT event, latency, depth, sum(greatest(0, least(size, depth - ahead))) AS filled,
 sum(greatest(0, least(size, depth - ahead)) * price) AS cost FROM walk GROUP BY 1, 2, 3),
tr AS (SELECT w.event, w.signal_time, w.latency, w.depth, w.won, w.book, p.filled, p.cost, p.cost / p.filled AS vwap,
 CASE WHEN w.book IS NULL THEN 'NO_POST_LATENCY_BOOK' WHEN coalesce(p.filled >= w.depth, false) THEN 'EXECUTED'
 ELSE 'INSUFFICIENT_DEPTH' END AS status
 FROM want w LEFT JOIN priced p USING (event, latency, depth)),
trades AS (SELECT *, CASE WHEN status = 'EXECUTED' THEN ceil(round(0.07::DOUBLE * depth * cost * (filled - cost)
 / (filled * filled) * 100, 9)) / 100 END AS fee FROM tr),
money AS (SELECT *, CASE WHEN won THEN depth ELSE 0 END - depth * vwap - fee AS pnl, depth * vwap + fee AS capital
 FROM trades)"""


@query("settlement_backtest", "F1 C17 C2 E2 B15 B17 D5", f"""WITH {TRADES_SQL}
SELECT latency, depth, count(*) AS selected, count(*) FILTER (status = 'EXECUTED') AS executed,
 count(*) FILTER (status = 'EXECUTED' AND won) AS wins,
 {six("sum(pnl) FILTER (status = 'EXECUTED')")} AS pnl, {six("sum(capital) FILTER (status = 'EXECUTED')")} AS capital,
 count(DISTINCT CASE WHEN status = 'EXECUTED' THEN signal_time END) AS dates,
 {six("sum(pnl) FILTER (status = 'EXECUTED') / sum(capital) FILTER (status = 'EXECUTED')")} AS roi
FROM money GROUP BY latency, depth""")
def settlement_backtest(spark, d):
    cells = summarize_cells(trades(spark, d), ["latency", "depth"], "signal_time")
    return cells.select(
        "latency", "depth", "selected", "executed", "wins", r6(F.col("pnl")).alias("pnl"),
        r6(F.col("capital")).alias("capital"), "dates", r6(F.col("roi")).alias("roi"),
    )


@query("depth_vwap", "E2", f"""WITH {LINES},
walk AS (SELECT book, price, size, depth, coalesce(sum(size) OVER (PARTITION BY book, depth ORDER BY price
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
 FROM (SELECT book, price, sum(size) AS size FROM lines GROUP BY 1, 2), (SELECT unnest([5.0, 40.0])::DOUBLE AS depth))
SELECT book, depth, sum(greatest(0, least(size, depth - ahead))) AS filled,
 {six("sum(greatest(0, least(size, depth - ahead)) * price) / sum(greatest(0, least(size, depth - ahead)))")} AS vwap,
 sum(greatest(0, least(size, depth - ahead))) >= depth AS complete FROM walk GROUP BY book, depth""")
def depth_vwap_query(spark, d):
    out = depth_vwap(book_lines(spark, d), ["book"], "price", "size", F.array(F.lit(5.0), F.lit(40.0)))
    return out.select("book", "depth", "filled", r6(F.col("vwap")).alias("vwap"), "complete")


@query("first_signal", "F1", f"""WITH {SIGNALS_SQL} SELECT event, signal_time, won, signal_key FROM sig""")
def first_signal(spark, d):
    return first_signals(spark, d).withColumn("signal_time", F.col("signal_time").cast("timestamp_ntz"))
