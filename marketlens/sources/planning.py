"""Plans over archives: which hours to read, what is there, what may expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.times import hours_ending_at, plus_seconds, settlement_end
from marketlens.operators.ordered import latest_per_key


def archive_hours(catalog: DataFrame, offset_hours: Column, *, final_hours: int = 6, per_event: bool = False) -> DataFrame:
    """The last UTC hours of each EXACT (station, date); one row per hour, or per hour and event.

    A shared hour belongs to the first event in (station, date) order.
    """
    if not 1 <= final_hours <= 24:
        raise ValueError("final_hours must be in 1..24")
    events = catalog.where(
        (F.col("status") == "EXACT") & F.col("station").isNotNull() & F.col("settlement_date").isNotNull()
    ).select(F.upper("station").alias("station"), "settlement_date", offset_hours.alias("_off")).distinct()
    end = settlement_end(F.col("settlement_date"), F.col("_off"))
    hours = events.select("station", "settlement_date", F.explode(hours_ending_at(end, final_hours)).alias("hour_utc"))
    return hours if per_event else latest_per_key(hours, ["hour_utc"], ["station", "settlement_date"], first=True)


def close_time_hours(contracts: DataFrame, *, final_hours: int, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """Hours that end at contract close; an exact-hour close counts the hour before. First contract wins."""
    hours = contracts.where(F.col("close_time").isNotNull()).select(
        "contract_id", "settlement_date", F.explode(hours_ending_at(F.col("close_time"), final_hours)).alias("hour_utc")
    )
    plan = latest_per_key(hours, ["hour_utc"], ["settlement_date", "contract_id"], first=True)
    ordered = plan.orderBy(F.desc("hour_utc") if newest_first else F.asc("hour_utc"))
    return ordered if limit is None else ordered.limit(limit)


def coverage(plan: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """LOCAL, PARTIAL or MISSING per planned row. ``files``: file_name, bytes."""
    present = files.groupBy("file_name").agg(F.max("bytes").alias("_bytes"))
    whole = present.where(F.col("_bytes") > 0).select(F.col("file_name").alias("_whole"))
    partial = present.where(F.col("file_name").endswith(".part")).select(F.col("file_name").alias("_part"))
    named = plan.withColumn("file_name", name)
    joined = named.join(whole, F.col("file_name") == F.col("_whole"), "left").join(
        partial, F.concat("file_name", F.lit(".part")) == F.col("_part"), "left"
    )
    status = F.when(F.col("_whole").isNotNull(), "LOCAL").when(F.col("_part").isNotNull(), "PARTIAL").otherwise("MISSING")
    return joined.select(*named.columns, status.alias("status"))


def list_files(spark, path: str) -> DataFrame:
    """File name, size and modification time below a path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def retention_plan(files: DataFrame, *, now: Column, days: int = 30, pattern: str) -> DataFrame:
    """Eligible or blocked state per UTC day that ended at or before ``now - days``.

    ``files``: day, file_name, bytes, modified, is_link. The first group of ``pattern`` is the date in a file's name. One
    unexpected name, link or recent change blocks the whole day. The result is a table; nothing is deleted.
    """
    cutoff = plus_seconds(now, F.lit(-86_400 * days))
    old = files.where(F.date_add("day", 1).cast("timestamp") <= cutoff)
    odd = (
        F.col("is_link") | ~F.col("file_name").rlike(pattern) | (F.regexp_extract("file_name", pattern, 1) != F.date_format("day", "yyyy-MM-dd"))
    )
    recent = F.col("modified") > cutoff
    per_day = old.groupBy("day").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max(odd).alias("_odd"), F.max(recent).alias("_recent")
    )
    state = F.when(F.col("_odd"), "BLOCKED_UNEXPECTED_ENTRY").when(F.col("_recent"), "BLOCKED_RECENTLY_MODIFIED").otherwise("ELIGIBLE")
    return per_day.select("day", "files", "bytes", state.alias("state"))
