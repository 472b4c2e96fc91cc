"""Exact de-duplication by a heavy-hitter split.

Texts are equal when they are equal without white space. A Misra-Gries summary (Spark's mergeable frequent-items
sketch) is folded inside the scan tasks, so that only sketches travel, and names the frequent digests. Their exact
winners and sizes are counted in a second pass, which combines before its shuffle, and at most ``tracked`` of them are
broadcast: rows of frequent digests are decided where they lie. All other digests, each rarer than a small share of
the rows, take an ordinary shuffle on the digest. Digests, not texts, move.

Defined results: null text counts as empty, all empty texts are one group; ties of length go to the smallest doc_id, a
null doc_id last; of rows that repeat doc_id and text exactly one stays; an empty table gives an empty result; other
columns of the input are neither read nor returned by ``decide`` and are returned unchanged by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE_CLASS, staged, text_key, whole_text

#: Digests that are decided by broadcast, and counters of the summary: the proven bound of what is broadcast.
HEAVY = 512
COUNTERS = 16_384


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, text_sha256 of the text without white space, n_points, and a row number."""
    text = whole_text()
    return docs.select(
        F.col("doc_id"),
        text_key().alias("text_hash"),
        F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", "").cast("binary"), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row"),
    )


def _winner() -> list:
    first = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("text_hash")))
    return [first.alias("first"), F.count(F.lit(1)).alias("group_size")]


def frequent(keys: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """At most ``heavy`` verified digests with winner and exact size; empty where no digest comes twice."""
    top = keys.select(F.xxhash64("text_sha256").alias("h")).agg(F.expr(f"approx_top_k(h, {heavy}, {counters})").alias("top"))
    named = top.select(F.explode("top").alias("t")).filter(F.col("t.count") > 1).select(F.col("t.item").alias("h"))
    seen = keys.join(F.broadcast(named), F.xxhash64(keys["text_sha256"]) == named["h"], "left_semi")
    return seen.groupBy("text_sha256").agg(*_winner()).filter("group_size > 1")


def decide(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and text_hash, twin (repeats the kept row)."""
    keys = staged(digests(docs), "digests")
    winners = staged(frequent(keys, heavy, counters).coalesce(1), "winners")
    split = keys.join(F.broadcast(winners), "text_sha256", "left")
    hot = split.filter("group_size is not null")
    rest = split.filter("group_size is null").drop("first", "group_size")
    cold = rest.join(rest.groupBy("text_sha256").agg(*_winner()), "text_sha256")
    names = ["doc_id", "text_hash", "text_sha256", "row", "first", "group_size"]
    kept = F.col("row") == F.col("first.row")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return hot.select(names).unionByName(cold.select(names)).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "text_hash", (same & ~kept).alias("twin")
    )


def keep_rows(docs: DataFrame, kept: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows of docs named in ``kept`` (doc_id, text_hash); those also in ``twins`` come several times and one stays."""
    def named(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
        return rows.join(k, rows["doc_id"].eqNullSafe(k["_kept_id"]) & (text_key() == k["_kept_hash"]), how)

    stay = named(docs, kept, "left_semi")
    if twins.isEmpty():
        return stay
    return named(stay, twins, "left_anti").unionByName(named(stay, twins, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without their copies, all columns as they came."""
    decided = staged(decide(docs), "exact")
    return keep_rows(docs, decided.filter("kept").select("doc_id", "text_hash"), decided.filter("twin").select("doc_id", "text_hash").distinct())
