"""Sources and sinks: the tables written in the archive formats, then read back by the readers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from marketlens.bindings.books import LEVEL, LOG, depth_log
from marketlens.bindings.evaluation import DRAWDOWN, INTERVAL, RET, VERDICT, draws_sql, returns
from marketlens.bindings.registry import query
from marketlens.bindings.views import EVENTS, events, orders
from marketlens.operators import books
from marketlens.operators import evaluate as ev
from marketlens.schemas import LEVELS, STRING, DOUBLE, BOOL, LONG, struct
from marketlens.session import scratch_path
from marketlens.sources import scans, sinks


@query("archive_scan", "A1", """SELECT CAST(event_id AS INTEGER) AS fee_rate_bps, CAST(user_id AS VARCHAR) AS asset_id, 'm' || user_id AS market, value AS price, 2 AS levels, value / 2 AS first_price FROM events
WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id IN (SELECT user_id FROM events WHERE value >= 250)""")
def archive_scan(spark, d):
    e = events(spark, d)
    price = F.col("value").cast("string")
    depth = F.concat(F.lit('[["'), (F.col("value") / 2).cast("string"), F.lit('","1"],["'), price, F.lit('","2"]]'))
    path = scratch_path(spark, "archive-in")
    e.select(
        F.col("ts").alias("timestamp_received"), F.col("ts").alias("timestamp"), F.encode(F.concat(F.lit("m"), F.col("user_id").cast("string")), "UTF-8").alias("market"),
        "event_type", F.col("user_id").cast("string").alias("asset_id"), depth.alias("bids"), depth.alias("asks"), F.col("value").alias("price"), F.col("value").alias("size"),
        F.lit("BUY").alias("side"), F.lit(None).cast("double").alias("best_bid"), F.lit(None).cast("double").alias("best_ask"), F.col("event_id").cast("int").alias("fee_rate_bps"),
    ).write.parquet(path)
    wanted = e.where(F.col("value") >= 250).select(F.col("user_id").cast("string").alias("asset_id"))
    rows = scans.read_archive(
        spark, [path], assets=wanted, kinds=["click", "view"], start=datetime(2024, 1, 5, tzinfo=timezone.utc),
        end=datetime(2024, 1, 20, tzinfo=timezone.utc),
    )
    return rows.select("fee_rate_bps", "asset_id", "market", "price", F.size("bids").alias("levels"), F.get("bids", F.lit(0))["price"].alias("first_price"))


@query("depth_scan", "A2 E1", f"WITH {LOG} SELECT ticker, CAST(epoch AS BIGINT) AS epoch, side, price, size FROM lev")
def depth_scan(spark, d):
    log = depth_log(spark, d).withColumns({c: F.col(c).cast(LEVELS) for c in ("yes_bids", "no_bids")})
    path = scratch_path(spark, "depth-in")
    log.select(
        F.col("received").alias("timestamp_received"), F.when(F.col("seq") % 2 == 0, F.col("ts")).alias("timestamp"), F.col("ticker").cast("string").alias("market_ticker"),
        F.lit("").alias("market_id"), "event_type", "yes_bids", "no_bids", F.col("price").cast("decimal(18,6)").alias("price"), F.col("delta").cast("decimal(18,6)").alias("delta"),
        F.upper("side").alias("side"),
    ).write.parquet(path)
    read = scans.read_depth_events(spark, [path])
    plain = read.withColumns({c: F.col(c).cast(LEVEL) for c in ("yes_bids", "no_bids")}).withColumns(
        {"price": F.col("price").cast("double"), "delta": F.col("delta").cast("double"), "ticker": F.col("ticker").cast("bigint")}
    )
    return books.level_changes(plain).select("ticker", "epoch", "side", "price", "size")


@query("compact_archive", "A3 C8", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 490000)")
def compact_archive(spark, d):
    keys = orders(spark, d).where(F.col("o_totalprice") >= 490_000).select(F.col("o_custkey").alias("user_id"))
    return sinks.compact_to_keys(events(spark, d), keys, "user_id", scratch_path(spark, "compact")).select("event_id", "user_id")


def json_lines(spark, d):
    """Events as JSON lines with blank, broken and non-object lines between them."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user"), "value"))
    broken = F.when(F.col("k") % 10 == 0, F.lit("")).when(F.col("k") % 10 == 1, F.substring(body, 1, 12)).when(F.col("k") % 10 == 2, F.lit("[1, 2]")).otherwise(body)
    path = scratch_path(spark, "lines")
    events(spark, d).orderBy("ts", "event_id").select(broken.alias("value")).write.text(path)
    return path


@query("json_lines_scan", "A4", f"WITH {EVENTS} SELECT event_id AS id, CAST(user_id AS VARCHAR) AS \"user\", value FROM ev WHERE k % 10 > 2")
def json_lines_scan(spark, d):
    return scans.read_json_lines(spark, json_lines(spark, d), struct(id=LONG, user=STRING, value=DOUBLE))


@query("keyed_json_lines", "A5", f"""WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS "user", arg_max(event_id, struct_pack(t := ts, e := event_id)) AS id, arg_max(value, struct_pack(t := ts, e := event_id)) AS value
FROM ev WHERE k % 10 > 2 GROUP BY user_id""")
def keyed_json_lines(spark, d):
    return scans.read_keyed_json_lines(spark, json_lines(spark, d), struct(id=LONG, user=STRING, value=DOUBLE), "user")


@query("csv_snapshot", "A6", f"""WITH {EVENTS} SELECT event_id, CASE WHEN k % 5 > 1 THEN value END AS price, k % 4 IN (0, 1) AS closed FROM ev""")
def csv_snapshot(spark, d):
    k = F.col("k")
    path = scratch_path(spark, "csv")
    closed = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "1").when(k % 4 == 2, "no").otherwise("false")
    price = F.when(k % 5 == 0, "NA").when(k % 5 == 1, "None").otherwise(F.col("value").cast("string"))
    events(spark, d).select("event_id", price.alias("price"), closed.alias("closed")).write.option("header", True).csv(path)
    return scans.read_snapshot_csv(spark, path, struct(event_id=LONG, price=DOUBLE, closed=BOOL))


@query("parquet_query", "A11", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def parquet_query(spark, d):
    return scans.parquet_query(
        spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
        "l_quantity >= :q AND l_returnflag = :flag", {"q": 45, "flag": "R"},
    )


@query("manifest_round_trip", "A13 B39", """SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS outcomes, o_orderstatus <> 'O' AS closed FROM orders""")
def manifest_round_trip(spark, d):
    o = orders(spark, d)
    done = F.col("o_orderstatus") == "F"
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("condition_id"), F.col("o_orderpriority").alias("question"),
        F.when(done, F.array(F.lit("Yes"), F.lit("No"))).alias("outcomes"), F.when(done, F.array(F.lit(1.0), F.lit(0.0))).alias("prices"),
        (F.col("o_orderstatus") != "O").alias("closed"),
    )
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(rows, path)
    return scans.read_manifest(spark, path).select("condition_id", F.size("outcomes").alias("outcomes"), "closed")


@query("recorded_parts", "A10", "SELECT event_id, CAST(ts AS DATE) AS date, 'v' || (user_id % 3) AS venue, event_type AS stream FROM events")
def recorded_parts(spark, d):
    path = scratch_path(spark, "record")
    e = events(spark, d)
    sinks.record(e, path, ts="ts", venue=F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")), stream=F.col("event_type"))
    return spark.read.parquet(path).select("event_id", "date", "venue", "stream")


@query("panel_union", "G6 D15", f"""WITH {RET}, {draws_sql(11, 's.pnl / s.capital')}, {INTERVAL}, {DRAWDOWN}, {VERDICT} SELECT strategy, events, dates, stations, verdict, round(net, 4) + 0.0 AS net FROM verdicts""")
def panel_union(spark, d):
    path = scratch_path(spark, "panel")
    rows = returns(spark, d).withColumn("panel", F.col("date"))
    rows.repartition("panel").write.partitionBy("panel").json(path)
    back = spark.read.schema(returns(spark, d).schema).option("recursiveFileLookup", True).json(path)
    out = ev.validate(back, ["strategy"], ["event", "station"], F.unix_date("date"))
    return out.select("strategy", "events", "dates", "stations", "verdict", (F.round("net", 4) + F.lit(0.0)).alias("net"))
