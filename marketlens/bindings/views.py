"""Typed views of the driver tables, and the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the zone-less clock read as UTC and the counter of ``props`` as a number."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def offset_hours(station: Column) -> Column:
    return -(F.lit(5) + station % 4)


#: Hours east of UTC of a station, in SQL.
OFFSET = "(-(5 + station % 4))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings ``(station, valid_time, temp, seq, day)``; the day is the local-standard date."""
    from marketlens.functions.times import settlement_date

    e = events(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("station"), F.col("ts").alias("valid_time"), F.col("value").alias("temp"),
        F.col("event_id").alias("seq"), "event_type", "k",
    ).withColumn("day", settlement_date(F.col("valid_time"), offset_hours(F.col("station"))))


OBS = EVENTS + f""", obs AS (SELECT *, CAST(valid_time + to_hours(CAST({OFFSET} AS BIGINT)) AS DATE) AS day FROM (
 SELECT user_id AS station, ts AS valid_time, value AS temp, event_id AS seq, event_type, k FROM ev))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and day: highest reading, first reading as forecast, whole official value."""
    o = observations(spark, sf_dir)
    return o.groupBy("station", "day").agg(
        F.max("temp").alias("high"), F.count(F.lit(1)).alias("n"),
        F.min_by("temp", F.struct("valid_time", "seq")).alias("forecast"),
        F.floor(F.max("temp") + 0.5).cast("double").alias("official"), F.min("temp").alias("low"),
    )


DAILY = OBS + """, daily AS (SELECT station, day, max(temp) AS high, count(*) AS n,
 arg_min(temp, struct_pack(t := valid_time, s := seq)) AS forecast, floor(max(temp) + 0.5) AS official, min(temp) AS low
 FROM obs GROUP BY station, day)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(events(spark, sf_dir))


def quotes_of(e: DataFrame) -> DataFrame:
    """Quotes ``(contract, ts, seq, yes_bid, yes_ask, no_bid, no_ask, size)`` from the event stream."""
    bid = F.round(F.lit(0.02) + F.col("k") * 0.0094, 4)
    return e.select(
        F.col("user_id").alias("contract"), "ts", F.col("event_id").alias("seq"), "event_type",
        bid.alias("yes_bid"), F.round(bid + 0.03, 4).alias("yes_ask"),
        F.round(F.lit(0.97) - bid, 4).alias("no_bid"), F.round(1 - bid, 4).alias("no_ask"),
        F.floor(F.col("value") + 1).cast("double").alias("size"), "value", "k",
    )


QUOTES = EVENTS + """, quotes AS (SELECT user_id AS contract, ts, event_id AS seq, event_type,
 round(0.02 + k * 0.0094, 4) AS yes_bid, round(round(0.02 + k * 0.0094, 4) + 0.03, 4) AS yes_ask,
 round(0.97 - round(0.02 + k * 0.0094, 4), 4) AS no_bid, round(1 - round(0.02 + k * 0.0094, 4), 4) AS no_ask,
 CAST(floor(value + 1) AS DOUBLE) AS size, value, k FROM (SELECT * REPLACE (CAST(k AS DOUBLE) AS k) FROM ev))"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as ask levels ``(book, price, size)``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("book"), F.round(F.lit(0.05) + 9 * F.col("l_discount"), 4).alias("price"),
        F.col("l_quantity").alias("size"),
    )


LINES = "lines AS (SELECT l_orderkey AS book, round(0.05 + 9 * l_discount, 4) AS price, l_quantity AS size FROM lineitem)"


def six(expr: str) -> str:
    """The SQL twin of ``functions.numbers.six``."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def two(expr: str) -> str:
    """The SQL twin of ``functions.numbers.two``."""
    return f"(round(CAST({expr} AS DOUBLE), 2) + 0.0)"
