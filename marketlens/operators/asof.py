"""As-of joins in both directions, as one union and one ordered pass per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ordered import BLOCK_SECONDS, running, time_block


def _stack(left, right, keys, left_time, right_time, right_cols, right_tie, right_first):
    """Both sides on one axis. The right side sorts before (or after) the left at equal times."""
    tie = F.struct(*right_tie) if right_tie else F.lit(0)
    payload = F.struct(*right_cols)
    ours = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1 if right_first else 0).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    theirs = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(0 if right_first else 1).alias("_side"),
        tie.alias("_tie"), payload.alias("_right"),
    )
    return ours.unionByName(theirs, allowMissingColumns=True)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    right_cols: Sequence[str], *, right_tie: Sequence[str] = (), block_seconds: int = BLOCK_SECONDS,
    how: str = "left",
) -> DataFrame:
    """For each left row the last right row with ``right_time <= left_time`` (ties: greatest ``right_tie``)."""
    stacked = _stack(left, right, keys, left_time, right_time, right_cols, right_tie, True)
    matched = running(
        stacked, keys, ["_t", "_side", "_tie"], {"_hit": ("last", F.col("_right"))}, time_block("_t", block_seconds)
    ).where(F.col("_left").isNotNull())
    if how == "inner":
        matched = matched.where(F.col("_hit").isNotNull())
    return matched.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in right_cols])


def asof_forward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    right_cols: Sequence[str], *, right_tie: Sequence[str] = (), latency: Column | None = None,
    tolerance_seconds: float | None = None, block_seconds: int = BLOCK_SECONDS, how: str = "left",
) -> DataFrame:
    """For each left row the first right row with ``right_time >= left_time + latency``.

    Ties take the least ``right_tie``. With a tolerance, a match later than that after the target
    is dropped (null columns under ``how='left'``). ``latency`` is seconds and may be a column, so
    several latencies are one pass over an exploded left side.
    """
    target = F.col(left_time) if latency is None else F.timestamp_micros(
        F.unix_micros(left_time) + (latency * F.lit(1e6)).cast("bigint")
    )
    aimed = left.withColumn("_target", target)
    stacked = _stack(aimed, right, keys, "_target", right_time, right_cols, right_tie, False)
    matched = running(
        stacked, keys, ["_t", "_side", "_tie"], {"_hit": ("last", F.col("_right"))},
        time_block("_t", block_seconds), descending=True,
    ).where(F.col("_left").isNotNull())
    hit = F.col("_hit")
    if tolerance_seconds is not None:
        delay = F.unix_micros(F.col(f"_hit.{right_time}")) - F.unix_micros(F.col("_t"))
        hit = F.when(delay <= F.lit(int(tolerance_seconds * 1_000_000)), hit)
    picked = matched.withColumn("_hit", hit)
    if how == "inner":
        picked = picked.where(F.col("_hit").isNotNull())
    return picked.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in right_cols]).drop("_target")
