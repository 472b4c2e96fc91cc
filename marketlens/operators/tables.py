"""Keyed facts, refreshes, fallbacks and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ordered import latest_per_key


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or replace by key: the newest row of the union, combined before the shuffle."""
    return latest_per_key(existing.unionByName(incoming), keys, order)


def merge_refreshed(history: DataFrame, fresh: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """A new row without an error replaces the old one; an error row never overwrites."""
    old = history.withColumn("_new", F.lit(0))
    new = fresh.where(F.col(error).isNull()).withColumn("_new", F.lit(1))
    return latest_per_key(old.unionByName(new), keys, ["_new"]).drop("_new")


def row_key(id_column: Column, columns: Sequence[str]) -> Column:
    """The id where given, else a digest of the whole row."""
    return F.coalesce(id_column.cast("string"), F.sha2(F.to_json(F.struct(*columns)), 256))


def merge_tiers(live: DataFrame, archived: DataFrame, id_column: str) -> DataFrame:
    """Union of both tiers, one row per id; the archived row wins, as the later source."""
    both = live.withColumn("_tier", F.lit(0)).unionByName(archived.withColumn("_tier", F.lit(1)))
    keyed = both.withColumn("_key", row_key(F.col(id_column), live.columns))
    return latest_per_key(keyed, ["_key"], ["_tier"]).select(*live.columns)


def fallback_when_empty(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Secondary rows only for the keys the primary has nothing for."""
    covered = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(covered, list(keys), "left_anti"))


def pick_source(
    ranked: DataFrame, key: Sequence[str], time: str, order: Sequence[str], now: Column, max_age_seconds: float
) -> DataFrame:
    """Rows of one source per key, one per time (last wins), with a freshness status.

    ``ranked`` holds a ``source_rank`` (lower is better). The best rank whose newest row is fresh is chosen, and only
    where no source is fresh the best rank of all.
    """
    key = list(key)
    age = (F.unix_micros(now) - F.unix_micros("_newest")) / F.lit(1e6)
    sources = ranked.groupBy(*key, "source_rank").agg(F.max(time).alias("_newest")).withColumn("_stale", age > max_age_seconds)
    best = sources.groupBy(*key).agg(F.min(F.struct("_stale", "source_rank")).alias("_b"))
    status = F.when(F.col("_b._stale"), "STALE").otherwise("OK").alias("status")
    picked = best.select(*key, F.col("_b.source_rank").alias("source_rank"), status)
    return latest_per_key(ranked.join(picked, [*key, "source_rank"]), [*key, time], order)


def refresh_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys added and removed between two refreshes."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("ADDED"))
    removed = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("REMOVED"))
    return added.unionByName(removed)


def missing_targets(targets: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return targets.select(*keys).distinct().join(observed.select(*keys), list(keys), "left_anti")


def modal_value(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group (first seen on ties), number of values and whether they disagree."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct("_n", -F.col("_first"))).alias("modal"), F.count(F.lit(1)).alias("values"),
        F.sum("_n").alias("rows"),
    ).withColumn("disagree", F.col("values") > 1)


def gate_events(legs: DataFrame, event: str, fresh: Column) -> DataFrame:
    """All legs of the events without a stale or missing leg."""
    judged = legs.groupBy(event).agg(F.min(F.coalesce(fresh, F.lit(False))).alias("_all_fresh"))
    return legs.join(judged.where(F.col("_all_fresh")), event, "left_semi")


def migrate_log(
    signals: DataFrame, fills: DataFrame, track_ids: dict[str, str], keys: Sequence[str] = ("strategy", "ticker", "time", "side")
) -> DataFrame:
    """Eligible fills of a legacy log re-keyed to their signals by (strategy, ticker, time, side).

    Track names map to strategy ids; unknown tracks and unmatched fills drop out.
    """
    mapping = F.create_map(*[F.lit(x) for pair in track_ids.items() for x in pair])

    def with_strategy(df: DataFrame) -> DataFrame:
        return df.withColumn("strategy", F.try_element_at(mapping, F.col("track"))).where(F.col("strategy").isNotNull())

    left = with_strategy(fills.where(F.col("status") == "PAPER_FILLED"))
    right = with_strategy(signals.where(F.col("status") == "SIGNAL")).select(*keys, "signal_id").distinct()
    return left.join(right, list(keys))
