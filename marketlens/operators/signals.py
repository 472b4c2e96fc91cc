"""Signal rules: each turns a snapshot with features into an evaluation with a reason.

Rules are column expressions, so several rules, tracks or sides of one snapshot are one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.contracts import contains
from marketlens.functions.numbers import fee_ceil_cent
from marketlens.functions.probability import provisional_probability, strike_probability
from marketlens.operators.selection import best_per_event, best_side, first_per_event

FEE_COEFFICIENT = 0.07

#: Gates of the three tracks (minutes, drop, slope, price floor, edge).
TRACKS = {
    "A_CONTROL": (60.0, 1.0, 0.02, 0.15, 0.08),
    "B_MODERATE": (45.0, 0.75, 0.03, 0.15, 0.06),
    "C_EXPLORATORY": (30.0, 0.50, 0.05, 0.10, 0.04),
}


def unit_fee(price: Column) -> Column:
    return fee_ceil_cent(FEE_COEFFICIENT, F.lit(1), price).cast("double")


def _trade(strategy: str, side: str, price: Column, fair: Column, passes: Column) -> Column:
    won = F.col("resolved_yes") if side == "YES" else ~F.col("resolved_yes")
    row = F.struct(
        F.lit(strategy).alias("strategy"), F.lit(side).alias("side"), price.alias("entry_price"),
        fair.cast("double").alias("fair_probability"), won.alias("won"),
        (won.cast("double") - price).alias("pnl"),
    )
    return F.when(F.coalesce(passes, F.lit(False)) & F.col("resolved_yes").isNotNull(), row)


def tournament_trades(
    snapshots: DataFrame, *, min_no: float = 0.85, max_no: float = 0.99, min_edge: float = 0.02, min_locked: float = 0.005
) -> DataFrame:
    """Blind NO, model NO, best YES and late elimination NO of every snapshot, settled in the same row."""
    costs = F.col("fees_per_share") + F.col("slippage_per_share")
    yes, no = F.col("yes_ask") + costs, F.col("no_ask") + costs
    fair_no = 1.0 - F.col("fair_yes")
    rules = F.array(
        _trade("blind_no", "NO", no, F.lit(None), no.between(min_no, max_no)),
        _trade("model_no", "NO", no, fair_no, fair_no - no >= min_edge),
        _trade("best_yes", "YES", yes, F.col("fair_yes"), F.col("fair_yes") - yes >= min_edge),
        _trade(
            "late_elimination_no", "NO", no, F.lit(1.0),
            (F.col("observed_high") > F.col("upper")) & (1.0 - no >= min_locked),
        ),
    )
    return snapshots.select("*", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("_t")).select(
        *snapshots.columns, "_t.*"
    )


def simple_signal(
    df: DataFrame, p_yes: Column, volume: Column, yes_bid: Column, yes_ask: Column, no_ask: Column, *, min_edge: float = 0.06,
    min_volume: float = 10.0, max_spread: float = 0.12,
) -> DataFrame:
    """Volume, spread and edge gates over the better side; adds side, ask, probability and edge."""
    bid = F.coalesce(yes_bid, F.greatest(F.lit(0.0), 1.0 - no_ask))
    spread = F.greatest(F.lit(0.0), yes_ask - bid)
    open_market = df.where((volume >= min_volume) & yes_ask.isNotNull() & no_ask.isNotNull() & (spread <= max_spread))
    gain = F.greatest(p_yes - yes_ask, (1 - p_yes) - no_ask)
    return open_market.where(gain >= min_edge).select("*", best_side(p_yes, yes_ask, no_ask).alias("_c")).select(*df.columns, "_c.*")


def evaluated(
    df: DataFrame, p_yes: Column, yes_ask: Column, no_ask: Column, min_edge: float, refusal: Column
) -> DataFrame:
    """Add reason, eligible, side, probability and edge of the better side, unless refused before.

    The probability and the choice are columns of their own, so each is computed once per row.
    """
    staged = df.withColumns({"_p": p_yes, "_refusal": refusal}).withColumn("_c", best_side(F.col("_p"), yes_ask, no_ask))
    reason = F.coalesce(
        F.col("_refusal"),
        F.when(F.col("_c").isNull(), "NO_EXECUTABLE_ASK").when(F.col("_c.edge") < min_edge, "EDGE_BELOW_MINIMUM"),
        F.lit("ELIGIBLE"),
    )
    open_side = F.col("_refusal").isNull()
    return staged.withColumns(
        {"reason": reason, **{n: F.when(open_side, F.col(f"_c.{n}")) for n in ("side", "probability", "edge")}}
    ).withColumn("eligible", F.col("reason") == "ELIGIBLE").drop("_p", "_refusal", "_c")


def _too_short(n: Column, minimum: int) -> Column:
    text = F.concat(F.lit("INSUFFICIENT_PRIOR_HISTORY:"), n.cast("string"), F.lit(f"<{minimum}"))
    return F.when(n < minimum, text)


def gaussian_bucket_rule(
    df: DataFrame, forecast: Column, uncertainty: Column, strike: Column, floor: Column, cap: Column, yes_ask: Column,
    no_ask: Column, *, bias: Column | None = None, history_n: Column | None = None, min_history: int = 0,
    min_edge: float = 0.05,
) -> DataFrame:
    """Gaussian strike probability, shifted by the station's prior bias once there is enough history."""
    refusal, mean = F.lit(None).cast("string"), forecast
    if bias is not None:
        refusal, mean = _too_short(F.coalesce(history_n, F.lit(0)), min_history), forecast + bias
    p = strike_probability(strike, floor, cap, mean, uncertainty, on_bad="null")
    return evaluated(df, p, yes_ask, no_ask, min_edge, refusal)


def empirical_rule(
    df: DataFrame, base: Column, samples: Column, shape: Column, lower: Column, upper: Column, yes_ask: Column,
    no_ask: Column, *, min_history: int = 30, min_edge: float = 0.05, source_family: Column | None = None,
    required_family: str = "NWS_CLI",
) -> DataFrame:
    """Share of ``base + residual`` samples inside the contract; abstains on short history or a wrong source."""
    held = F.coalesce(samples, F.array().cast("array<double>"))
    inside = F.filter(held, lambda s: contains(shape, lower, upper, base + s, on_bad="false"))
    refusal = _too_short(F.size(held), min_history)
    if source_family is not None:
        family = F.upper(F.coalesce(source_family, F.lit("MISSING")))
        wrong = F.when(family != required_family, F.concat(F.lit("INCOMPATIBLE_SETTLEMENT_SOURCE:"), family))
        refusal = F.coalesce(wrong, refusal)
    share = F.when(F.size(held) > 0, F.size(inside) / F.size(held))
    return evaluated(df, share, yes_ask, no_ask, min_edge, refusal)


def eliminated_rule(
    high: Column, strike: Column, floor: Column, cap: Column, no_ask: Column, verified: Column, *, min_edge: float = 0.02,
    max_no_ask: float = 0.98,
) -> Column:
    """NO on a bucket that the observed high has already ruled out."""
    name = F.lower(strike)
    eliminated = (
        F.when((name == "between") & cap.isNotNull(), high > cap).when((name == "less") & cap.isNotNull(), high >= cap)
        .otherwise(F.lit(False))
    )
    edge = 1.0 - no_ask
    reason = (
        F.when(~F.coalesce(verified, F.lit(False)), "UNVERIFIED_SETTLEMENT_SEMANTICS")
        .when(~eliminated, "NOT_ELIMINATED").when(no_ask.isNull(), "NO_EXECUTABLE_NO_ASK")
        .when((edge < min_edge) | (no_ask > max_no_ask), "EDGE_OR_PRICE_GATE").otherwise("ELIGIBLE")
    )
    return F.struct(
        reason.alias("reason"), (reason == "ELIGIBLE").alias("eligible"), F.when(eliminated, edge).alias("edge")
    )


def with_fees(df: DataFrame, yes_ask: Column, no_ask: Column) -> DataFrame:
    """Rows with an ask, and the fee of one contract per side, each computed once."""
    return df.where(yes_ask.isNotNull() | no_ask.isNotNull()).withColumns({"_yfee": unit_fee(yes_ask), "_nfee": unit_fee(no_ask)})


def with_net_best_side(df: DataFrame, p_yes: Column, yes_ask: Column, no_ask: Column) -> DataFrame:
    """Add side, ask, probability, gross, fee and net of the side with the greater edge after its fee.

    Needs :func:`with_fees`. Yes wins ties.
    """
    gross = df.withColumns({"_yg": p_yes - yes_ask, "_ng": (1.0 - p_yes) - no_ask})
    net = gross.withColumns({"_yn": F.col("_yg") - F.col("_yfee"), "_nn": F.col("_ng") - F.col("_nfee")})
    yes = F.col("_yn").isNotNull() & (F.col("_nn").isNull() | (F.round("_yn", 9) >= F.round("_nn", 9)))
    picked = net.withColumn("_yes", yes)

    def pick(a: Column, b: Column) -> Column:
        return F.when(F.col("_yes"), a).otherwise(b)

    return picked.withColumns({
        "side": pick(F.lit("YES"), F.lit("NO")), "ask": pick(yes_ask, no_ask), "probability": pick(p_yes, 1.0 - p_yes),
        "gross": pick(F.col("_yg"), F.col("_ng")), "fee": pick(F.col("_yfee"), F.col("_nfee")), "net": pick(F.col("_yn"), F.col("_nn")),
    }).drop("_yes", "_yg", "_ng", "_yn", "_nn", "_yfee", "_nfee")


BEST_COLUMNS = ("side", "ask", "probability", "gross", "fee", "net")


def track_decisions(snapshots: DataFrame, tracks: Mapping[str, Sequence[float]] = TRACKS) -> DataFrame:
    """Every snapshot under every track; rows without any ask drop out.

    Snapshots carry yes_ask, no_ask, in_bucket, minutes_since_high, drop and slope.
    """
    table = F.array(
        *[
            F.struct(F.lit(n).alias("track"), *[F.lit(v).alias(c) for c, v in zip(("m", "d", "s", "floor", "min_edge"), t)])
            for n, t in tracks.items()
        ]
    )
    spread = with_fees(snapshots, F.col("yes_ask"), F.col("no_ask")).withColumn("_t", F.explode(table))
    locked = F.coalesce(
        (F.col("minutes_since_high") >= F.col("_t.m")) & (F.col("drop") >= F.col("_t.d")) & (F.col("slope") <= F.col("_t.s")),
        F.lit(False),
    )
    p = provisional_probability(F.col("in_bucket"), F.col("locked"), F.col("drop"), F.col("slope"))
    priced = spread.withColumn("locked", locked).withColumn("p_yes", p)
    out = with_net_best_side(priced, F.col("p_yes"), F.col("yes_ask"), F.col("no_ask"))
    decision = (
        F.when(~F.col("locked"), "LOCK_GATE_FAIL").when(F.col("ask") < F.col("_t.floor"), "PRICE_BELOW_FLOOR")
        .when(F.round("gross", 9) < F.col("_t.min_edge"), "EDGE_BELOW_MINIMUM")
        .when(F.round("net", 9) <= 0, "NEGATIVE_AFTER_FEE").otherwise("PAPER_TRADE_ELIGIBLE")
    )
    return out.select(*snapshots.columns, F.col("_t.track").alias("track"), "locked", "p_yes", *BEST_COLUMNS, decision.alias("decision"))


def track_tournament(snapshots: DataFrame, event: Sequence[str], tie: Sequence[str], tracks=TRACKS) -> DataFrame:
    """Best contract per event and track by edge after fee; its own decision is the event's decision."""
    return best_per_event(
        track_decisions(snapshots, tracks).withColumn("_rank", F.round("net", 9)), [*event, "track"], "_rank", tie
    ).drop("_rank")


def diagnostic_decisions(snapshots: DataFrame, *, price_floor: float = 0.15, min_edge: float = 0.04) -> DataFrame:
    """The gate bypassed, with the margin to each of its thresholds; missing inputs block."""
    minutes, drop, slope, floor, _ = TRACKS["A_CONTROL"]
    failures = F.filter(
        F.array(
            F.when(F.col("minutes_since_high").isNull(), "LOCK_FAIL_TIME_MISSING").when(
                F.col("minutes_since_high") < minutes, "LOCK_FAIL_TIME"),
            F.when(F.col("drop").isNull(), "LOCK_FAIL_DROP_MISSING").when(F.col("drop") < drop, "LOCK_FAIL_DROP"),
            F.when(F.col("slope").isNull(), "LOCK_FAIL_SLOPE_MISSING").when(F.col("slope") > slope, "LOCK_FAIL_POSITIVE_SLOPE"),
        ),
        lambda r: r.isNotNull(),
    )
    p = provisional_probability(F.col("in_bucket"), F.lit(True), F.col("drop"), F.col("slope"))
    priced = with_fees(snapshots, F.col("yes_ask"), F.col("no_ask")).withColumns({"failures": failures, "_p": p})
    out = with_net_best_side(priced, F.col("_p"), F.col("yes_ask"), F.col("no_ask"))
    decision = (
        F.when(F.exists("failures", lambda r: r.endswith("_MISSING")), "DATA_INCOMPLETE")
        .when(F.col("ask") < price_floor, "PRICE_BELOW_FLOOR")
        .when(F.round("gross", 9) < min_edge, "EDGE_BELOW_MINIMUM")
        .when(F.round("net", 9) <= 0, "NEGATIVE_AFTER_FEE").otherwise("DIAGNOSTIC_PAPER_ELIGIBLE")
    )
    return out.select(
        *snapshots.columns, "failures", (F.size("failures") == 0).alias("would_pass"),
        (F.col("minutes_since_high") - minutes).alias("minutes_margin"), (F.col("drop") - drop).alias("drop_margin"),
        (F.lit(slope) - F.col("slope")).alias("slope_margin"),
        ((F.size("failures") <= 1) & (F.round("net", 9) > 0)).alias("near_signal"), *BEST_COLUMNS, decision.alias("decision"),
    )


def monotonic_lock(
    df: DataFrame, shape: Column, lower: Column, upper: Column, high: Column, yes_ask: Column, no_ask: Column, *,
    margin: float = 2.0, max_price: float = 0.97, min_gap: float = 0.02,
) -> DataFrame:
    """Rows whose high is beyond a bound by the margin, with side, ask and the gap left after the fee."""
    side = F.when(shape.isin("bucket", "below") & (high >= upper + margin), "NO").when(
        (shape == "above") & (high >= lower + margin), "YES"
    )
    locked = df.withColumn("side", side).where(F.col("side").isNotNull())
    asked = locked.withColumn("ask", F.when(F.col("side") == "YES", yes_ask).otherwise(no_ask)).where(F.col("ask") <= max_price)
    return asked.withColumn("gap", 1.0 - F.col("ask") - unit_fee(F.col("ask"))).where(F.round("gap", 9) >= min_gap)


def live_decision(
    traded: Column, pending: Column, age_minutes: Column, locked: Column, ask: Column, edge: Column, net: Column, *,
    floor: float, min_edge: float, max_age: float = 100.0,
) -> Column:
    """Live precedence: traded, pending, no observation, stale, gate, price, edge, fee."""
    return (
        F.when(traded, "ALREADY_TRADED_EVENT").when(pending, "PENDING_DELAYED_FILL")
        .when(age_minutes.isNull(), "NO_LIVE_OBSERVATION").when(age_minutes > max_age, "STALE_OBSERVATION")
        .when(~locked, "LOCK_GATE_FAIL").when(ask < floor, "PRICE_BELOW_FLOOR")
        .when(F.round(edge, 9) < min_edge, "EDGE_BELOW_MINIMUM").when(F.round(net, 9) <= 0, "NEGATIVE_AFTER_FEE")
        .otherwise("PAPER_TRADE_ELIGIBLE")
    )


def forward_status(
    traded: Column, pending: Column, locked: Column, ask: Column, gross: Column, net: Column, *, floor: float, min_edge: float
) -> Column:
    """Gate that stops a contract, in fixed precedence."""
    return (
        F.when(traded, "ALREADY_TRADED_EVENT").when(pending, "PENDING_DELAYED_FILL")
        .when(~F.coalesce(locked, F.lit(False)), "LOCK_GATE_FAIL").when(ask.isNull(), "NO_EXECUTABLE_QUOTE")
        .when(ask < floor, "PRICE_BELOW_FLOOR")
        .when(gross.isNull() | (F.round(gross, 9) < min_edge), "EDGE_BELOW_MINIMUM")
        .when(net.isNull() | (F.round(net, 9) <= 0), "NEGATIVE_AFTER_FEE").otherwise("PAPER_TRADE_ELIGIBLE")
    )


def top_decile_triggers(rows: DataFrame, place: str, day: str, *, minimum: int = 20) -> DataFrame:
    """Once per place and day, where the prior history is long enough and the rank is in the top decile."""
    return rows.where((F.col("history_n") >= minimum) & (F.col("percentile") >= 90.0)).dropDuplicates([place, day])


def once_per_event(signals: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str]) -> DataFrame:
    """Label each signal: the first of its event claims it, later ones are marked."""
    claim = first_per_event(signals.withColumn("_z", F.lit(0)), keys, time, "_z", tie)
    claimed = claim.select(*tie).withColumn("_first", F.lit(True))
    return signals.join(claimed, list(tie), "left").withColumn(
        "status", F.when(F.coalesce("_first", F.lit(False)), "SIGNAL").otherwise("ALREADY_SIGNALED_EVENT")
    ).drop("_first")


def missing_features(features: Column, required: Column, nullable: Column) -> Column:
    """Names a payload lacks: absent, or null where null is not allowed."""
    return F.filter(
        required,
        lambda name: ~F.map_contains_key(features, name)
        | (F.get(F.map_values(F.map_filter(features, lambda k, _: k == name)), F.lit(0)).isNull() & ~F.array_contains(nullable, name)),
    )
