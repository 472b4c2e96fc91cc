"""Ladders of contracts over one event: partition proof, best run of legs, locked baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.ordered import ordinal, previous_row

#: Texts every leg must agree on, and the supported domain/rounding pairs.
BASIS_FIELDS = ("source", "station", "date", "measurement", "window", "unit", "rounding", "value_domain")
DOMAINS = {"INTEGER": "WHOLE_DEGREE", "CONTINUOUS": "NONE"}


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def _bounds(domain: Column) -> dict[str, Column]:
    """Bounds made inclusive on an integer domain."""
    whole = domain == "INTEGER"
    return {
        "lo": F.when(whole & ~F.col("lower_inclusive"), F.col("lower") + 1).otherwise(F.col("lower")),
        "hi": F.when(whole & ~F.col("upper_inclusive"), F.col("upper") - 1).otherwise(F.col("upper")),
        "li": whole | F.col("lower_inclusive"),
        "ui": whole | F.col("upper_inclusive"),
    }


def ladder_proof(legs: DataFrame, members: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """First reason why the legs of an event are not an exact partition, or EXACT_PARTITION.

    ``legs``: event_id, ticker, pos, shape, lower, upper, lower_inclusive, upper_inclusive, mapping_status,
    evidence and the basis fields. ``members``: event_id, ticker as the venue lists them. Every test
    is an aggregate; adjacency compares each leg with the one before it, in one window per event: a ladder is short. The aggregates go over the rows as
    the window leaves them, so the legs are shuffled once, or not at all if they come by event in as many ``tasks``, which share the members too.
    """
    domain = F.col("value_domain")
    b = _bounds(domain)
    leg = legs.withColumns({**b, "basis": F.struct(*BASIS_FIELDS)})
    semantics = F.when(
        F.coalesce(F.col("mapping_status") != "EXACT", F.lit(True)) | _blank(F.col("evidence"))
        | F.exists(F.array(*BASIS_FIELDS), _blank),
        "SETTLEMENT_SEMANTICS_UNVERIFIED",
    ).when(F.col("lower_inclusive").isNull() | F.col("upper_inclusive").isNull(), "INCLUSIVITY_UNVERIFIED")
    finite = [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(True)) for c in (F.col("lower"), F.col("upper"))]
    has_lo, has_hi = F.col("lower").isNotNull(), F.col("upper").isNotNull()
    shaped = (
        ((F.col("shape") == "below") & ~has_lo & has_hi) | ((F.col("shape") == "above") & has_lo & ~has_hi)
        | ((F.col("shape") == "bucket") & has_lo & has_hi)
    )
    fraction = F.coalesce(F.col("lower") != F.floor("lower"), F.lit(False)) | F.coalesce(
        F.col("upper") != F.floor("upper"), F.lit(False)
    )
    empty = F.coalesce(
        (F.col("lo") > F.col("hi")) | ((F.col("lo") == F.col("hi")) & ~(F.col("li") & F.col("ui"))), F.lit(False)
    )
    bounds = (
        F.when(~(finite[0] & finite[1]), "INVALID_BOUND").when(~F.coalesce(shaped, F.lit(False)), "INVALID_SHAPE_BOUNDS")
        .when((domain == "INTEGER") & fraction, "NONINTEGER_BOUND").when(empty, "EMPTY_OR_REVERSED_INTERVAL")
    )
    leg = leg.withColumns({"_semantics": semantics, "_bounds": bounds, "_has": F.col("lo").isNotNull()})
    leg = previous_row(leg, ["event_id"], ["_has", "lo", "pos"], {"_phi": "hi", "_pui": "ui", "_ppos": "pos"}, None)
    open_tail = F.col("_phi").isNull() | F.col("lo").isNull()
    apart = F.when(domain == "INTEGER", F.col("_phi") + 1 != F.col("lo")).otherwise(
        (F.col("_phi") != F.col("lo")) | (F.col("_pui") == F.col("li"))
    )
    pair_reason = F.when(open_tail, "OVERLAPPING_TAILS").when(apart, "GAP_OR_OVERLAP")
    leg = leg.withColumn("_pair", F.when(F.col("_ppos").isNotNull(), pair_reason))

    def first_reason(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("pos")))

    facts = leg.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("legs"),
        F.max(_blank(F.col("ticker"))).alias("_no_ticker"), first_reason("_semantics").alias("_semantics"),
        first_reason("_bounds").alias("_bounds"), F.min("basis").alias("_basis"),
        (F.min("basis") != F.max("basis")).alias("_mixed"),
        *[F.count_if(F.col("shape") == s).alias(f"_{s}") for s in ("below", "above", "bucket")],
        F.max_by("hi", F.struct(F.col("lo").isNotNull(), "lo", "pos")).alias("_top_hi"),
        F.max(F.col("lo").isNull()).alias("_open_low"),
        F.min_by("_pair", F.when(F.col("_pair").isNotNull(), F.struct("_has", "lo", "pos"))).alias("_pair"),
    )
    listed = members.select("event_id", "ticker", F.lit(1).alias("_listed"), F.lit(0).alias("_seen"))
    seen = legs.select("event_id", "ticker", F.lit(0).alias("_listed"), F.lit(1).alias("_seen"))
    both = listed.union(seen)
    if tasks:
        both = both.repartition(tasks, "event_id")
    membership = both.groupBy("event_id", "ticker").agg(F.sum("_listed").alias("_times"), F.sum("_seen").alias("_seen")).groupBy("event_id").agg(
        F.max((F.col("_times") != 1) | (F.col("_seen") == 0) | _blank(F.col("ticker"))).alias("_not_members"),
        F.count_if((F.col("_seen") > 0) & F.col("ticker").isNotNull()).alias("_tickers"),
    )
    table = facts.join(membership, "event_id", "left")
    supported = F.lit(False)
    for name, rounding in DOMAINS.items():
        supported = supported | ((F.col("_basis.value_domain") == name) & (F.col("_basis.rounding") == rounding))
    reason = F.coalesce(
        F.when(F.col("legs") < 3, "TOO_FEW_LEGS"),
        F.when(F.col("_no_ticker") | (F.col("_tickers") != F.col("legs")), "DUPLICATE_OR_MISSING_CONTRACT"),
        F.when(F.coalesce("_not_members", F.lit(True)), "CANONICAL_MEMBERSHIP_INCOMPLETE"),
        F.col("_semantics"),
        F.when(F.col("_mixed"), "MIXED_SETTLEMENT_BASIS"),
        F.when((F.col("_basis.unit") != "F") | ~supported, "UNSUPPORTED_PRECISION"),
        F.col("_bounds"),
        F.when((F.col("_below") != 1) | (F.col("_above") != 1) | (F.col("_bucket") < 1), "MISSING_OR_DUPLICATE_TAIL"),
        F.when(~F.col("_open_low") | F.col("_top_hi").isNotNull(), "UNBOUNDED_TAILS_MISSING"),
        F.col("_pair"),
        F.lit("EXACT_PARTITION"),
    )
    return table.select("event_id", "legs", reason.alias("reason"))


def underround(legs: DataFrame, proof: DataFrame, minimum_edge: float) -> DataFrame:
    """Baskets of all YES or all NO legs that cost less than they must pay, on proven ladders only.

    ``legs``: event_id, yes_ask, yes_fee, no_ask, no_fee.
    """

    def side(name: str) -> list[Column]:
        ask, fee = F.col(f"{name}_ask"), F.col(f"{name}_fee")
        good = F.coalesce(ask.between(0, 1) & (fee >= 0) & (fee < float("inf")), F.lit(False))
        return [F.min(good).alias(f"_{name}_ok"), F.sum(ask + fee).alias(f"_{name}_cost")]

    costs = legs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_legs"), *side("yes"), *side("no"))
    proven = costs.join(proof.where(F.col("reason") == "EXACT_PARTITION").select("event_id"), "event_id", "left_semi")
    baskets = proven.select(
        "event_id", "n_legs",
        F.explode(
            F.array(
                F.struct(F.lit("BASKET_YES").alias("side"), F.col("_yes_ok").alias("ok"), F.col("_yes_cost").alias("cost"),
                         F.lit(1.0).alias("payout")),
                F.struct(F.lit("BASKET_NO").alias("side"), F.col("_no_ok").alias("ok"), F.col("_no_cost").alias("cost"),
                         (F.col("n_legs") - 1).cast("double").alias("payout")),
            )
        ).alias("_b"),
    ).select("event_id", "n_legs", "_b.*")
    return baskets.where(F.col("ok")).withColumn("edge", F.col("payout") - F.col("cost")).where(
        F.col("edge") >= minimum_edge
    ).drop("ok")


def best_run(
    legs: DataFrame, event: Sequence[str], order: Sequence[str], block: Column, *, fair: str = "fair", cost: str = "cost",
    max_legs: int = 6, minimum_edge: float = 0.02, chunk: int = 4096, tasks: int | None = None,
) -> DataFrame:
    """The contiguous legs with the greatest fair minus cost, earliest and shortest on ties.

    Legs get their exact position in two levels, positions are cut into chunks, and the first legs of
    a chunk are copied to the chunk before it, so every run of ``max_legs`` lies inside one chunk. ``tasks`` share blocks and chunks; a leg gives
    its best run only, in the order of its chunk, so nothing is sorted again.
    """
    event = list(event)
    placed = ordinal(legs, event, order, "_pos", block, tasks=tasks)
    own = F.floor((F.col("_pos") - 1) / chunk)
    edge_of_chunk = ((F.col("_pos") - 1) % chunk < max_legs - 1) & (own > 0)
    copied = placed.withColumn(
        "_chunk", F.explode(F.when(edge_of_chunk, F.array(own, own - 1)).otherwise(F.array(own)))
    ).withColumn("_mine", F.col("_chunk") == own)
    if tasks:
        copied = copied.repartition(tasks, *event, "_chunk")
    runs = []
    for k in range(max_legs):
        w = Window.partitionBy(*event, "_chunk").orderBy("_pos").rowsBetween(0, k)
        whole = F.count(F.lit(1)).over(w) == k + 1
        gain = F.round(F.sum(fair).over(w) - F.sum(cost).over(w), 9)
        runs.append(F.when(whole, F.struct(gain.alias("edge"), (-F.col("_pos")).alias("p"), F.lit(-k - 1).alias("l"))))
    measured = copied.select(*event, "_mine", F.array_max(F.array(*runs)).alias("_r")).where(F.col("_mine"))
    best = measured.groupBy(*event).agg(F.max("_r").alias("_b"))
    return best.select(
        *event, F.col("_b.edge").alias("edge"), (-F.col("_b.p")).alias("first_leg"), (-F.col("_b.l")).cast("bigint").alias("run_legs")
    ).where(F.col("edge") >= minimum_edge)


def locked_pairs(quotes: DataFrame, event: str = "event_id", venue: str = "venue") -> DataFrame:
    """Best YES of one venue against best NO of another: edge of the locked payout.

    Quotes shrink to one row per event and venue first, so pairs are bounded by the venues squared.
    """
    best = quotes.groupBy(event, venue).agg(F.min("yes_all_in").alias("yes"), F.min("no_all_in").alias("no"))
    yes = best.where(F.col("yes").isNotNull()).select(event, F.col(venue).alias("yes_venue"), "yes")
    no = best.where(F.col("no").isNotNull()).select(event, F.col(venue).alias("no_venue"), "no")
    return yes.join(no, event).where(F.col("yes_venue") != F.col("no_venue")).withColumn(
        "locked_edge", 1.0 - F.col("yes") - F.col("no")
    )


def normalized_probabilities(df: DataFrame, event: Sequence[str], raw: str, name: str = "p") -> DataFrame:
    """Probabilities over their sum per event; left alone where the sum is zero."""
    totals = df.groupBy(*event).agg(F.sum(raw).alias("_total"))
    out = df.join(totals, list(event))
    return out.withColumn(name, F.when(F.col("_total") != 0, F.col(raw) / F.col("_total")).otherwise(F.col(raw))).drop("_total")
