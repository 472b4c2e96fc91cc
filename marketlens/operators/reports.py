"""Daily report of a paper track from its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numbers import roi
from marketlens.operators.ordered import latest_per_key


def daily_report(
    signals: DataFrame, fills: DataFrame, settled: DataFrame, contracts: DataFrame, *, contract: str, event: str,
    order: list[str], eligible: Column,
) -> DataFrame:
    """One row per day: signals, fills, settled, money, contracts, eligible and missed ones.

    All frames hold ``day``. ``contracts`` keeps the last row per contract and day; an eligible one
    whose event has no signal that day is missed.
    """
    latest = latest_per_key(contracts, ["day", contract], order)
    good = latest.where(eligible)
    missed = good.join(signals.select("day", event).distinct(), ["day", event], "left_anti")
    days = latest.select("day").union(signals.select("day")).union(fills.select("day")).union(settled.select("day")).distinct()

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("day").agg(F.count(F.lit(1)).alias(name))

    money = settled.groupBy("day").agg(
        F.count(F.lit(1)).alias("settled"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"),
        F.sum("pnl").alias("net"), F.sum("capital").alias("capital"),
    )
    out = days
    for part in (
        rows(signals, "signals"), rows(fills, "fills"), rows(latest, "contracts"), rows(good, "eligible"), rows(missed, "missed"), money
    ):
        out = out.join(part, "day", "left")
    counts = ("signals", "fills", "contracts", "eligible", "missed", "settled", "wins", "losses")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumns(
        {"net": F.coalesce("net", F.lit(0.0)), "capital": F.coalesce("capital", F.lit(0.0))}
    ).withColumn("roi", roi(F.col("net"), F.col("capital")))


def decision_counts(contracts: DataFrame, contract: str, order: list[str]) -> DataFrame:
    """Decisions of the last row per contract and day."""
    return latest_per_key(contracts, ["day", contract], order).groupBy("day", F.coalesce("decision", F.lit("UNKNOWN")).alias("decision")).agg(
        F.count(F.lit(1)).alias("contracts")
    )
