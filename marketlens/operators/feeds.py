"""Batch twins of the live rules: sequence gates, best quotes, freshness, health, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ordered import BLOCK_SECONDS, latest_per_key, previous_row, running, time_block


def sequence_status(messages: DataFrame, *, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Continuity of each message: APPLIED, DUPLICATE, GAP, INVALIDATED or UNSEQUENCED.

    ``messages``: connection, sid, seq, is_book, ts, pos (arrival order). Numbers belong to a
    subscription, a break belongs to the connection: everything after its first gap waits for a new
    connection. A book message without a number is a gap. ``missing`` counts the numbers that a gap left out.
    """
    numbered = F.col("sid").isNotNull() & F.col("seq").isNotNull()
    keyed = messages.withColumn("_sid", F.coalesce("sid", F.lit(-1)))
    seen = running(
        keyed, ["connection", "_sid"], ["ts", "pos"], {"_before": ("max", F.col("seq"))}, time_block("ts", block_seconds),
        current=False,
    )
    raw = (
        F.when(~numbered & F.col("is_book"), "GAP").when(~numbered, "UNSEQUENCED")
        .when(F.col("_before").isNull(), "APPLIED").when(F.col("seq") <= F.col("_before"), "DUPLICATE")
        .when(F.col("seq") > F.col("_before") + 1, "GAP").otherwise("APPLIED")
    )
    judged = seen.withColumn("_raw", raw)
    breaks = judged.where(F.col("_raw") == "GAP").groupBy("connection").agg(F.min(F.struct("ts", "pos")).alias("_break"))
    out = judged.join(breaks, "connection", "left")
    after = F.col("_break").isNotNull() & (F.struct("ts", "pos") > F.col("_break"))
    status = F.when(after, "INVALIDATED").otherwise(F.col("_raw"))
    lost = F.when((status == "GAP") & numbered, F.col("seq") - F.col("_before") - 1).otherwise(0)
    return out.select(*messages.columns, status.alias("status"), lost.cast("long").alias("missing"))


def live_levels(changes: DataFrame) -> DataFrame:
    """The books now, off the changes of ``state.live_book_stream``: connection, ticker, side, price, size of each live level.

    A level is void if its ticker has a newer book or its connection a gap.
    """
    level = F.col("status") == "LEVEL"
    last = changes.where(level).groupBy("connection", "ticker", "side", "price").agg(F.max_by(F.struct("epoch", "size"), F.struct("epoch", "ts", "pos")).alias("_l"))
    newest = changes.where(F.col("status") == "BOOK").groupBy("connection", "ticker").agg(F.max("epoch").alias("_now"))
    gaps = changes.where(F.col("status") == "GAP").select("connection").distinct()
    live = last.join(newest, ["connection", "ticker"]).where((F.col("_l.epoch") == F.col("_now")) & (F.col("_l.size") > 0))
    return live.join(gaps, "connection", "left_anti").select("connection", "ticker", "side", "price", F.col("_l.size").alias("size"))


def best_quotes(quotes: DataFrame, key: str, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Latest quote per key; the carried trade fields come from the last row that had them."""
    newest = latest_per_key(quotes.drop(*carried), [key], order)
    last = quotes.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in carried]
    )
    return newest.join(last, key)


def of_series(df: DataFrame, ticker: str, series: Sequence[str]) -> DataFrame:
    """Rows whose ticker belongs to one of the series: the part before the first dash, in any case."""
    return df.where(F.upper(F.get(F.split(F.col(ticker), "-"), 0)).isin(*series))


def complement_quote(df: DataFrame) -> DataFrame:
    """NO side of a YES quote: complement prices and swapped sizes."""
    return df.withColumns({
        "no_bid": 1 - F.col("yes_ask"), "no_ask": 1 - F.col("yes_bid"), "no_bid_size": F.col("yes_ask_size"),
        "no_ask_size": F.col("yes_bid_size"),
    })


def type_counts(messages: DataFrame, ts: str, kind: str, width: str = "1 hour") -> DataFrame:
    """Messages per type and window with the last time seen."""
    return messages.groupBy(F.window(ts, width).alias("_w"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen")
    ).select(F.col("_w.start").alias("window_start"), kind, "n", "last_seen")


def snapshot_key(catalogue: Column, quotes: Column, surface: Column) -> Column:
    """Identity of a set of inputs: the times of its catalogue, its quotes and, if it is fresh, its surface."""
    return F.concat(catalogue.cast("string"), F.lit("|"), quotes.cast("string"), F.lit("|"), F.coalesce(surface.cast("string"), F.lit("")))


def fresh(ts: Column, now: Column, max_age_seconds: float) -> Column:
    """Known, not in the future and not too old."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6)
    return F.coalesce((age >= 0) & (age <= max_age_seconds), F.lit(False))


def assess_health(df: DataFrame, *, stamp: str, error: str, now: Column, limit: Column) -> DataFrame:
    """Status and reason at read time: a row that stopped changing turns stale by itself."""
    age = (F.unix_micros(now) - F.unix_micros(stamp)) / F.lit(1e6)
    reason = (
        F.when(F.col(stamp).isNull() | (age < 0), "INVALID_HEALTH_TIMESTAMP")
        .when(limit.isNull() | (limit <= 0), "INVALID_HEALTH_TTL").when(age > limit, "STALE_HEALTH")
        .when(F.col(error).isNotNull(), F.col(error)).otherwise("CURRENT_HEALTH")
    )
    return df.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason") == "CURRENT_HEALTH", "OK").otherwise("ERROR")
    )


def health_transitions(
    statuses: DataFrame, component: str, ts: str, order: Sequence[str], *, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """One row when a component turns bad or its reason changes, one when it recovers."""
    signed = statuses.withColumn("_sig", F.when(F.col("status") == "ERROR", F.col("reason")).otherwise(""))
    before = previous_row(signed, [component], [ts, *order], {"_old": "_sig"}, time_block(ts, block_seconds))
    old = F.coalesce("_old", F.lit(""))
    return before.where(F.col("_sig") != old).select(
        *statuses.columns, F.when(old == "", "OK").otherwise("ERROR").alias("previous_status"), old.alias("previous_reason")
    )


def compare_cycles(left: DataFrame, right: DataFrame, cycle: str, counts: Sequence[str], *, after: Column, stamp: str) -> DataFrame:
    """Reasons why two outputs of one cycle do not belong together; an empty array passes."""
    r = right.select(cycle, F.lit(True).alias("_has"), *[F.col(c).alias(f"_r_{c}") for c in (stamp, *counts)])
    both = left.join(r, cycle, "left")
    checks = [
        F.when(F.col("_has").isNull(), "missing_current"),
        F.when(F.col(stamp) != F.col(f"_r_{stamp}"), "snapshot_health_not_same_cycle"),
        F.when((F.col(stamp) <= after) | (F.col(f"_r_{stamp}") <= after), "no_new_successful_cycle"),
        *[F.when(F.col(c) != F.col(f"_r_{c}"), f"count_mismatch_{c}") for c in counts],
    ]
    return both.select(*left.columns, F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("errors"))
