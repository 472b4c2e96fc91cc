"""Label every book of a contract with what was knowable at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.priors import posterior
from marketlens.operators.surface import GATE, causal_state, gate_reasons


def label_books(
    books: DataFrame, obs: DataFrame, history: DataFrame, *, usable: Column, minimum_samples: int = 20,
    minimum_edge: float = 0.05, keys: Sequence[str] = ("station", "day"), gate: dict[str, float] = GATE,
    slope_seconds: int = 900,
) -> DataFrame:
    """INSUFFICIENT_PRIOR, LOCK_GATE_FAIL, NO_EDGE or CANDIDATE with side, price and gross edge.

    ``books``: station, day, book_time, shape, lower, upper, yes_bid, no_bid. Books outside their
    settlement window must be gone. ``history``: station, day, basis. Asks are complements of the other
    side's bid; edges are gross.
    """
    state = causal_state(obs, books, "book_time", keys, slope_seconds=slope_seconds)
    reasons = gate_reasons(
        F.col("high"), F.col("latest"), F.col("minutes_since_high"), F.col("drop"), F.col("slope"),
        min_minutes=gate["minutes"], min_drop=gate["drop"], max_slope=gate["slope"],
    )
    gated = state.withColumn("gate_reasons", reasons).withColumn("locked", F.size("gate_reasons") == 0)
    priced = posterior(
        gated, history, [keys[0]], keys[1], value="basis", usable=usable, minimum=minimum_samples
    ).withColumns({"yes_ask": 1 - F.col("no_bid"), "no_ask": 1 - F.col("yes_bid")})
    edges = priced.withColumns({
        "yes_edge": F.col("p_yes") - F.col("yes_ask"), "no_edge": (1 - F.col("p_yes")) - F.col("no_ask"),
    })
    yes_first = F.col("yes_edge").isNotNull() & (
        F.col("no_edge").isNull() | (F.round("yes_edge", 9) >= F.round("no_edge", 9))
    )
    best = edges.withColumn("_edge", F.when(yes_first, F.col("yes_edge")).otherwise(F.col("no_edge"))).withColumn(
        "_take", F.col("locked") & F.coalesce(F.round("_edge", 9) >= minimum_edge, F.lit(False))
    )
    status = (
        F.when(F.col("p_yes").isNull(), "INSUFFICIENT_PRIOR").when(~F.col("locked"), "LOCK_GATE_FAIL")
        .when(~F.col("_take"), "NO_EDGE").otherwise("CANDIDATE")
    )
    candidate = F.col("status") == "CANDIDATE"
    return best.withColumn("status", status).withColumns({
        "side": F.when(candidate, F.when(yes_first, "YES").otherwise("NO")), "edge": F.when(candidate, F.col("_edge")),
        "price": F.when(candidate, F.when(yes_first, F.col("yes_ask")).otherwise(F.col("no_ask"))),
    }).drop("_edge", "_take")
