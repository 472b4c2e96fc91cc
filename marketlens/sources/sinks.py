"""Writers: compacted archives, partitioned records, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmptyResult(ValueError):
    """A write that would leave nothing behind."""


def compact_to_keys(raw: DataFrame, keys: DataFrame, key: str, path: str) -> DataFrame:
    """Write the rows whose key is in the catalogue as zstd Parquet; an empty set or result is refused.

    The key side is a catalogue; Spark broadcasts it while it is measured small and shuffles it
    otherwise. Emptiness of the result is read back from the written files.
    """
    if keys.limit(1).isEmpty():
        raise EmptyResult("no eligible keys")
    raw.join(keys.select(key).distinct(), key, "left_semi").write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = raw.sparkSession.read.parquet(path)
    if out.limit(1).isEmpty():
        raise EmptyResult(f"no row of the archive has an eligible key: {path}")
    return out


def with_record_partitions(df: DataFrame, ts: str, venue: Column, stream: Column) -> DataFrame:
    return df.withColumns({"date": F.to_date(ts), "venue": venue, "stream": stream})


def record(df: DataFrame, path: str, *, ts: str, venue: Column, stream: Column) -> None:
    """Append to ``date=/venue=/stream=`` Parquet with few files per partition.

    Rebalancing gathers the rows of small partitions and lets AQE split a crowded one.
    """
    parts = with_record_partitions(df, ts, venue, stream)
    parts.hint("rebalance", "date", "venue", "stream").write.mode("append").partitionBy("date", "venue", "stream").parquet(path)


def record_lines(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Append JSON lines, each stamped with the time it was archived."""
    stamped = df.withColumn("archived_at", F.current_timestamp())
    writer = stamped.write.mode("append").option("compression", "gzip")
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
