"""Sharding by a two-pass external shuffle.

First pass: each record goes to the shard that wins the seeded hash of (doc_id, shard), and inside the shard to a bucket
by another seeded hash, so buckets are uniform and of a size that fits in memory; their number follows the bytes. One
exchange moves each record once. Second pass: each bucket is put in a fixed order, then Fisher-Yates shuffled with a seed
(Spark's ``shuffle``), and its records get the slots after those of the buckets before it. Law ``key``: doc_id and the
number of shards alone decide the shard, and one more shard takes records only into itself, because it wins only against
the former winner.

Defined results: null text has no bytes; all null doc_ids lie in one shard; rows that repeat lie in one shard, each with
a slot; copies of a doc_id spread over the shard's buckets by their text; an empty table gives an empty result; further
columns travel with the record, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import staged, text_key, whole_text

SHARDS, SEED, BUCKET_BYTES = 24, 20_260, 16 << 20


def winner(doc_id: Column, shards: int, seed: int) -> Column:
    """struct<h, s>: the highest hash over the shards and its shard."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(doc_id, s, F.lit(seed)).alias("h"), s.alias("s"))))


def record_bytes() -> Column:
    return F.octet_length(whole_text()).cast("long") + 8


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Struct ``record`` (the row of docs) with size, text_crc32, shard, slot and grown_shard."""
    sizes = staged(docs.select("doc_id", text_key().alias("k"), record_bytes().alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // (shards * bucket_bytes)))

    def placed(rows: DataFrame, key: Column) -> DataFrame:
        rows = rows.withColumn("_w", winner(F.col("doc_id"), shards, seed)).withColumn("_key", key)
        bucket = F.pmod(F.xxhash64("doc_id", "_key", F.lit(seed + 1)), F.lit(per_shard)).cast("int")
        return rows.withColumn("_shard", F.col("_w.s")).withColumn("_bucket", bucket)

    counts = placed(sizes, F.col("k")).groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(counts.select("_shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "slots")
    rows = docs.select("doc_id", F.struct("*").alias("_record"), whole_text().alias("_text"))
    keyed = placed(rows, F.xxhash64("_text"))
    grown = F.when(F.xxhash64("doc_id", F.lit(shards), F.lit(seed)) > F.col("_w.h"), F.lit(shards)).otherwise(F.col("_shard"))
    sent = keyed.select(
        "_shard", "_bucket", "doc_id", "_key",
        F.struct(F.col("_record").alias("record"), (F.octet_length("_text").cast("long") + 8).alias("size"), F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
                 grown.alias("grown_shard")).alias("_r"),
    )
    buckets = (
        sent.repartition(shards * per_shard, "_shard", "_bucket").sortWithinPartitions("_shard", "_bucket", "doc_id", "_key")
        .groupBy("_shard", "_bucket").agg(F.collect_list("_r").alias("_rs"))
    )
    mixed = buckets.join(first, ["_shard", "_bucket"]).select("_shard", "_first", F.posexplode(F.shuffle("_rs", seed)).alias("_at", "_r"))
    return mixed.select(
        F.col("_r.record").alias("record"), F.col("_r.size").alias("size"), F.col("_r.text_crc32").alias("text_crc32"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_at")).alias("slot"), F.col("_r.grown_shard").cast("int").alias("grown_shard"),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its records in slot order inside each file."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
