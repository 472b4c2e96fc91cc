"""Ranked choices: first signal per event, best contract per event, best side per contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_event(df: DataFrame, keys: Sequence[str], time: str, edge: str, tie: Sequence[str]) -> DataFrame:
    """The earliest row per event; at the same time the greatest edge, then the least tie key."""
    rank = F.struct(F.col(time), (-F.col(edge)).alias("_e"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def best_per_event(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The row with the greatest score per event, ties to the least tie key. Filter afterwards."""
    rank = F.struct((-F.col(score)).alias("_s"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def best_side(p_yes: Column, yes_ask: Column, no_ask: Column) -> Column:
    """Struct (side, ask, probability, edge): the greater of yes and no edge, yes on ties, null when unpriced."""
    yes_edge = p_yes - yes_ask
    no_edge = (1 - p_yes) - no_ask
    take_yes = yes_edge.isNotNull() & (no_edge.isNull() | (yes_edge >= no_edge))
    return F.when(
        take_yes,
        F.struct(
            F.lit("YES").alias("side"), yes_ask.alias("ask"), p_yes.alias("probability"), yes_edge.alias("edge")
        ),
    ).when(
        no_edge.isNotNull(),
        F.struct(
            F.lit("NO").alias("side"), no_ask.alias("ask"), (1 - p_yes).alias("probability"), no_edge.alias("edge")
        ),
    )


def first_hour_with_best(
    df: DataFrame, event: Sequence[str], hour: str, edge: str, tie: Sequence[str], qualifies: Column
) -> DataFrame:
    """Best row inside each hour first, thresholds second, then the first hour that passes."""
    best = best_per_event(df, [*event, hour], edge, tie).where(qualifies)
    return first_per_event(best, event, hour, edge, tie)


def latest_snapshot(df: DataFrame, time: str) -> DataFrame:
    """Rows at the greatest snapshot time: a one-row maximum, then a semi join."""
    newest = df.agg(F.max(time).alias(time))
    return df.join(newest, time, "left_semi")


def rank_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order)
