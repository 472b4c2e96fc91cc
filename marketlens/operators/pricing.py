"""Quotes against signals: latency-aware fills, markouts, threshold crossings, settlement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numbers import capital_at_risk, terminal_pnl
from marketlens.functions.times import plus_seconds
from marketlens.operators.asof import asof_forward
from marketlens.operators.ordered import BLOCK_SECONDS, running, time_block

FeeFunction = Callable[[Column, Column], Column]

QUOTE_COLUMNS = ["ts", "yes_bid", "yes_ask", "no_bid", "no_ask", "size"]


def side_ask(side: Column, yes_ask: Column, no_ask: Column, yes_bid: Column, no_bid: Column) -> Column:
    """Ask of a side, else the complement of the other side's bid."""
    return F.when(side == "YES", F.coalesce(yes_ask, 1 - no_bid)).otherwise(F.coalesce(no_ask, 1 - yes_bid))


def delayed_fills(
    signals: DataFrame, quotes: DataFrame, *, latency: Column, contracts: int, slippage: float = 0.0,
    stress_ticks: int = 0, tick: float = 0.01, fee: FeeFunction, block_seconds: int = BLOCK_SECONDS,
    tolerance_seconds: float | None = None,
) -> DataFrame:
    """First quote at or after signal plus latency, taken at touch plus adverse ticks.

    Quantity is capped by the quoted size; without a quote or an ask the row keeps a status only.
    """
    hit = asof_forward(
        signals, quotes, ["contract"], "signal_time", "ts", QUOTE_COLUMNS, right_tie=["seq"], latency=latency,
        block_seconds=block_seconds, tolerance_seconds=tolerance_seconds,
    )
    touch = side_ask(F.col("side"), F.col("yes_ask"), F.col("no_ask"), F.col("yes_bid"), F.col("no_bid"))
    quantity = F.least(F.lit(contracts).cast("bigint"), F.floor("size"))
    adverse = slippage + stress_ticks * tick
    price = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), touch + F.lit(float(adverse))))
    status = (
        F.when(F.col("ts").isNull(), "NO_MARKET_QUOTE").when(touch.isNull(), "NO_EXECUTABLE_ASK")
        .when(quantity <= 0, "NO_SIZE").otherwise("FILLED")
    )
    priced = hit.withColumn("status", status).withColumn("quantity", F.when(F.col("status") == "FILLED", quantity))
    priced = priced.withColumn("price", F.when(F.col("status") == "FILLED", price))
    return priced.withColumn("fee", F.when(F.col("status") == "FILLED", fee(F.col("price"), F.col("quantity")))).withColumnRenamed(
        "ts", "fill_time"
    )


def markouts(
    signals: DataFrame, quotes: DataFrame, horizons: Sequence[int], *, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Value at the side's bid of the first quote at or after each horizon; once per signal and horizon."""
    aimed = signals.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons])))
    hit = asof_forward(
        aimed, quotes, ["contract"], "signal_time", "ts", ["ts", "yes_bid", "no_bid"], right_tie=["seq"],
        latency=F.col("horizon"), block_seconds=block_seconds, how="inner",
    )
    due = plus_seconds(F.col("signal_time"), F.col("horizon"))
    return hit.withColumn("value", F.when(F.col("side") == "YES", F.col("yes_bid")).otherwise(F.col("no_bid"))).withColumn(
        "delay_seconds", (F.unix_micros("ts") - F.unix_micros(due)) / F.lit(1e6)
    )


def settle(fills: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills joined to the result of their contract; a side wins when it equals the result."""
    won = F.col("side") == F.col("result")
    out = fills.join(results, list(keys))
    return out.withColumn("won", won).withColumn(
        "pnl", terminal_pnl(F.col("won"), F.col("quantity"), F.col("price"), F.col("fee"))
    ).withColumn("capital", capital_at_risk(F.col("quantity"), F.col("price"), F.col("fee")))


def threshold_fills(
    quotes: DataFrame, key: str, thresholds: Sequence[float], latencies: Sequence[int], *, cap: float,
    ask: str = "ask", fee_bps: str = "fee_bps", block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """First time an ask reaches each threshold without passing the cap, filled after each latency.

    The fill is the first later event whose ask is still within the cap; the last fee rate known
    by then applies. The trigger is a plain minimum, so it combines before the shuffle.
    """
    rated = running(
        quotes, [key], ["ts", "seq"], {"_bps": ("last", F.greatest(F.lit(0.0), F.col(fee_bps).cast("double")))},
        time_block("ts", block_seconds),
    )
    usable = rated.where((F.col(ask) > 0) & (F.col(ask) <= cap))
    offered = usable.select(
        key, "ts", ask, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    )
    triggers = offered.where(F.col(ask) >= F.col("threshold")).groupBy(key, "threshold").agg(F.min("ts").alias("signal_time"))
    aimed = triggers.withColumn("latency", F.explode(F.array(*[F.lit(x).cast("bigint") for x in latencies])))
    hit = asof_forward(
        aimed, usable, [key], "signal_time", "ts", ["ts", ask, "_bps"], right_tie=["seq"], latency=F.col("latency"),
        block_seconds=block_seconds, how="inner",
    )
    fee = F.col(ask) * F.coalesce(F.col("_bps"), F.lit(0.0)) / 10_000.0
    return hit.select(
        key, "threshold", "latency", "signal_time", F.col("ts").alias("fill_time"), F.col(ask).alias("price"),
        fee.alias("fee"),
    )
