"""Small fixed dimensions: station clocks and the exact series of daily temperature contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Station, civil time zone, hours east of UTC of its local standard time.
STATION_CLOCKS = (
    ("KNYC", "America/New_York", -5), ("KMIA", "America/New_York", -5), ("KBOS", "America/New_York", -5),
    ("KATL", "America/New_York", -5), ("KDCA", "America/New_York", -5), ("KPHL", "America/New_York", -5),
    ("KTTN", "America/New_York", -5), ("KEWR", "America/New_York", -5), ("KSDF", "America/Kentucky/Louisville", -5),
    ("KMDW", "America/Chicago", -6), ("KAUS", "America/Chicago", -6), ("KMSP", "America/Chicago", -6),
    ("KMSY", "America/Chicago", -6), ("KSAT", "America/Chicago", -6), ("KDFW", "America/Chicago", -6),
    ("KOKC", "America/Chicago", -6), ("KIAH", "America/Chicago", -6), ("KDEN", "America/Denver", -7),
    ("KPHX", "America/Phoenix", -7), ("KLAX", "America/Los_Angeles", -8), ("KSFO", "America/Los_Angeles", -8),
    ("KSEA", "America/Los_Angeles", -8), ("KLAS", "America/Los_Angeles", -8), ("KSAN", "America/Los_Angeles", -8),
)

#: Exact daily-high and daily-low series; a longer ticker with the same start is not one.
HIGH_SERIES = (
    "KXHIGHNY", "KXHIGHCHI", "KXHIGHMIA", "KXHIGHLAX", "KXHIGHTSFO", "KXHIGHDEN", "KXHIGHTBOS", "KXHIGHAUS", "KXHIGHTSEA",
    "KXHIGHTATL", "KXHIGHTLV", "KXHIGHTMIN", "KXHIGHTNOLA", "KXHIGHTDC", "KXHIGHPHIL", "KXHIGHTSATX", "KXHIGHTDAL",
    "KXHIGHTOKC", "KXHIGHTPHX", "KXHIGHTHOU", "KXHIGHTTTN", "KXHIGHTSDF", "KXHIGHTEWR", "KXHIGHTSAN",
)
LOW_SERIES = (
    "KXLOWTNYC", "KXLOWTCHI", "KXLOWTMIA", "KXLOWTLAX", "KXLOWTSFO", "KXLOWTDEN", "KXLOWTBOS", "KXLOWTAUS", "KXLOWTSEA",
    "KXLOWTATL", "KXLOWTLV", "KXLOWTMIN", "KXLOWTNOLA", "KXLOWTDC", "KXLOWTPHIL", "KXLOWTSATX", "KXLOWTDAL", "KXLOWTOKC",
    "KXLOWTPHX", "KXLOWTHOU", "KXLOWTTTN", "KXLOWTSDF", "KXLOWTEWR", "KXLOWTSAN",
)


def station_clocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATION_CLOCKS, "station string, zone string, offset_hours int")


def is_daily_series(series: Column) -> Column:
    return series.isin(*HIGH_SERIES, *LOW_SERIES)


def in_scope(
    *, series: Column | None = None, venues: Column | None = None, venue: str | None = None, day: Column | None = None,
    start: str | None = None, end: str | None = None, status: Column | None = None, wanted_status: str | None = None,
) -> Column:
    """Scope predicate: exact series, venue tag, inclusive dates, status. All parts push down."""
    out = F.lit(True)
    if series is not None:
        out = out & is_daily_series(series)
    if venues is not None and venue is not None:
        out = out & F.array_contains(venues, venue)
    if day is not None and start is not None:
        out = out & (day >= F.lit(start).cast("date"))
    if day is not None and end is not None:
        out = out & (day <= F.lit(end).cast("date"))
    if status is not None and wanted_status is not None:
        out = out & (status == wanted_status)
    return out


def fee_rates(facts: DataFrame, schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified fee per (venue, series), else per venue; rows without one go to the second frame.

    ``schedule``: venue, series (null = whole venue), rate, verified. It is a dimension; Spark
    broadcasts it while its measured size is under the session's threshold and shuffles it beyond.
    """
    exact = schedule.where(F.col("series").isNotNull()).select(
        "venue", "series", F.struct("rate", "verified").alias("_exact")
    )
    general = schedule.where(F.col("series").isNull()).select("venue", F.struct("rate", "verified").alias("_general"))
    joined = facts.join(exact, ["venue", "series"], "left").join(general, "venue", "left").withColumn(
        "_fee", F.coalesce("_exact", "_general")
    )
    known = F.col("_fee").isNotNull() & F.col("_fee.verified")
    good = joined.where(F.coalesce(known, F.lit(False))).select(*facts.columns, F.col("_fee.rate").alias("fee_rate"))
    reason = F.when(F.col("_fee").isNull(), "NO_FEE_SCHEDULE").otherwise("FEE_NOT_VERIFIED")
    bad = joined.where(~F.coalesce(known, F.lit(False))).select(*facts.columns, reason.alias("reason"))
    return good, bad
