"""Replay of one registered strategy over all its cases, as one chain of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import evaluate, pricing
from marketlens.operators.pricing import FeeFunction
from marketlens.operators.signals import missing_features
from marketlens.session import cut_lineage

#: A strategy turns case rows into the same rows with reason, eligible, side, probability and edge.
Strategy = Callable[[DataFrame], DataFrame]


def python_strategy(evaluate_batch: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Strategy:
    """A strategy from plain Python over Arrow batches, for rules columns cannot express."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield evaluate_batch(part)

    return lambda df: df.mapInPandas(batches, schema)


def evaluate_cases(cases: DataFrame, strategy: Strategy, required: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Evaluation of every case; a case that lacks a registered feature abstains with its name."""
    none = F.array().cast("array<string>")
    names = F.array(*[F.lit(n) for n in required]) if required else none
    allowed = F.array(*[F.lit(n) for n in nullable]) if nullable else none
    judged = strategy(cases.withColumn("_missing", missing_features(F.col("features"), names, allowed)))
    lacking = F.size("_missing") > 0
    text = F.concat(F.lit("MISSING_REGISTERED_FEATURES:"), F.array_join("_missing", ","))
    return judged.withColumns({
        "reason": F.when(lacking, text).otherwise(F.col("reason")),
        "eligible": ~lacking & F.coalesce("eligible", F.lit(False)),
        **{c: F.when(~lacking, F.col(c)) for c in ("side", "probability", "edge")},
    }).drop("_missing")


def replay(
    cases: DataFrame, quotes: DataFrame, results: DataFrame, strategy: Strategy, *, name: str, required: Sequence[str],
    fee: FeeFunction, latency: Column, contracts: int, horizons: Sequence[int] = (60, 300, 900),
) -> DataFrame:
    """Evaluate, fill, mark, settle and summarise; one scorecard row.

    ``cases``: case_id, contract, signal_time, features, date, station. ``quotes``: contract, ts, seq and
    the quote columns. ``results``: contract, result.
    """
    # Evaluations feed the counts, the fills and the marks; storing them runs the strategy once.
    evaluations = cut_lineage(evaluate_cases(cases, strategy, required).withColumn("strategy", F.lit(name)))
    signals = evaluations.where("eligible").withColumnRenamed("case_id", "signal_id")
    # The fills are few and read three times; storing them reads the quotes once.
    filled = cut_lineage(
        pricing.delayed_fills(signals, quotes, latency=latency, contracts=contracts, fee=fee).where(F.col("status") == "FILLED")
    )
    facts = filled.select("signal_id", F.col("signal_id").alias("fill_id"), F.col("fill_time").alias("filled_at"), "price", F.col("quantity").alias("contracts"), "fee")
    money = pricing.settle(filled, results, ["contract"]).select(F.col("signal_id").alias("fill_id"), "pnl")
    marked = signals.join(filled.select("signal_id"), "signal_id", "left_semi")
    marks = pricing.markouts(marked, quotes, horizons).select("signal_id", "horizon", "value")
    return evaluate.scorecard(
        evaluations.select("strategy"), signals.select("strategy", "signal_id", "date", "station"), facts, money, marks
    )
