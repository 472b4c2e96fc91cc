"""First signal per event, filled through depth after a latency, settled, summed per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numbers import capital_at_risk, fee_of_fill, roi, terminal_pnl
from marketlens.operators.asof import asof_forward
from marketlens.operators.books import merge_levels, walk_levels
from marketlens.session import cut_lineage


def parameter_grid(signals: DataFrame, latencies: Sequence[float]) -> DataFrame:
    """One row per signal and latency, without a join."""
    return signals.withColumn("latency", F.explode(F.array(*[F.lit(float(x)) for x in latencies])))


def execute(
    signals: DataFrame, books: DataFrame, levels: DataFrame, *, latencies: Sequence[float], depths: Sequence[float],
    fee_coefficient: float, block_seconds: int,
) -> DataFrame:
    """Trades per signal, latency and depth.

    ``signals``: event, signal_time, won. ``books``: event, book_time, book. ``levels``: book, price, size.
    """
    aimed = parameter_grid(signals, latencies)
    found = asof_forward(
        aimed, books, ["event"], "signal_time", "book_time", ["book_time", "book"], right_tie=["book"],
        latency=F.col("latency"), block_seconds=block_seconds,
    )
    # Only the few books that were found are merged.
    found = cut_lineage(found)
    wanted = found.select("book").where(F.col("book").isNotNull()).distinct()
    ladder = merge_levels(levels.join(wanted, "book", "left_semi"), ["book"], "price", "size")
    # Everything found rides along as a group key, so the as-of result is read once.
    trades = walk_levels(
        found.join(ladder, "book", "left"), found.columns, ["event", "latency"], "price", "size",
        F.array(*[F.lit(float(d)) for d in depths]),
    )
    filled = F.coalesce(F.col("complete"), F.lit(False))
    status = (
        F.when(F.col("book").isNull(), "NO_POST_LATENCY_BOOK")
        .when(~filled, "INSUFFICIENT_DEPTH")
        .otherwise("EXECUTED")
    )
    fee = fee_of_fill(fee_coefficient, F.col("depth"), F.col("cost"), F.col("filled"))
    return (
        trades.withColumn("status", status)
        .withColumn("fee", F.when(F.col("status") == "EXECUTED", fee))
        .withColumn("pnl", terminal_pnl(F.col("won"), F.col("depth"), F.col("vwap"), F.col("fee")))
        .withColumn("capital", capital_at_risk(F.col("depth"), F.col("vwap"), F.col("fee")))
    )


def summarize_cells(trades: DataFrame, cell: Sequence[str], date: str) -> DataFrame:
    """Selected, executed, wins, money and distinct dates per parameter cell."""
    done: Column = F.col("status") == "EXECUTED"
    out = trades.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(done).alias("executed"),
        F.count_if(done & F.col("won")).alias("wins"),
        F.sum(F.when(done, F.col("pnl"))).alias("pnl"),
        F.sum(F.when(done, F.col("capital"))).alias("capital"),
        F.count_distinct(F.when(done, F.col(date))).alias("dates"),
    )
    return out.withColumn("roi", roi(F.col("pnl"), F.col("capital")))
