"""Judging a strategy: roll-ups, blocks, resampling, verdicts, scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numbers import roi
from marketlens.operators.ordered import max_drawdown, time_block
from marketlens.session import cut_lineage

#: Thresholds of the verdicts and their order of merit.
MIN_EVENTS, MIN_DATES, MIN_STATIONS, DATES_TO_KEEP = 30, 20, 2, 50
VERDICT_MERIT = {"keep": 3, "provisional": 2, "insufficient_data": 1, "kill": 0}


def event_rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One return per event: earliest date, summed profit and capital."""
    return rows.groupBy(*keys).agg(
        F.min("date").alias("date"), F.sum("pnl").alias("pnl"), F.sum("capital").alias("capital")
    )


def date_rollup(events: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One row per cell and date. From here on a cell is bounded by the calendar."""
    return events.groupBy(*cell, "date").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl"),
        F.sum("capital").alias("capital"),
    )


def strategy_summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    each = F.when(F.col("capital") > 0, F.col("pnl") / F.col("capital")).otherwise(0.0)
    wins = F.count_if(F.col("pnl") > 0)
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), wins.alias("wins"), (wins / F.count(F.lit(1))).alias("win_rate"),
        F.sum("pnl").alias("pnl"), F.avg(each).alias("mean_roi"),
    )


def with_blocks(per_date: DataFrame, cell: Sequence[str], blocks: int) -> DataFrame:
    """Chronological blocks of dates; larger blocks come last."""
    w = Window.partitionBy(*cell)
    n = F.count(F.lit(1)).over(w)
    p = F.row_number().over(w.orderBy("date")) - 1
    b = F.least(F.lit(blocks).cast("bigint"), n)
    return per_date.withColumn("block", F.floor((b * (p + 1) - 1) / n))


def block_rollup(per_date: DataFrame, cell: Sequence[str], blocks: int) -> DataFrame:
    out = with_blocks(per_date, cell, blocks).groupBy(*cell, "block").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("dates"),
        F.sum("pnl").alias("pnl"), F.sum("capital").alias("capital"),
    )
    return out.withColumn("roi", roi(F.col("pnl"), F.col("capital")))


def leave_one_date_out(per_date: DataFrame, cell: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*cell)
    pnl = F.sum("pnl").over(w) - F.col("pnl")
    capital = F.sum("capital").over(w) - F.col("capital")
    return per_date.select(
        *cell, "date", pnl.alias("pnl_without"), capital.alias("capital_without"), roi(pnl, capital).alias("roi_without")
    )


def concentration(per_date: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Share of all positive profit that comes from the best one and three dates, best and worst date."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("pnl"), "date"))
    gain = F.when(F.col("pnl") > 0, F.col("pnl"))
    ranked = per_date.withColumn("_r", rank).groupBy(*cell).agg(
        F.sum(gain).alias("_all"), F.sum(F.when(F.col("_r") <= 1, gain)).alias("_top1"),
        F.sum(F.when(F.col("_r") <= 3, gain)).alias("_top3"),
        F.max_by("date", F.struct("pnl", "date")).alias("best_date"),
        F.min_by("date", F.struct("pnl", "date")).alias("worst_date"),
    )
    return ranked.select(
        *cell, (F.col("_top1") / F.col("_all")).alias("top1_share"), (F.col("_top3") / F.col("_all")).alias("top3_share"),
        "best_date", "worst_date",
    )


#: A prime modulus and odd multipliers of the seeded draws.
DRAW_MODULUS = 2_147_483_647
DRAW_A, DRAW_B, DRAW_SEED = 1_103_515_245, 12_345, 2_654_435_761


def draw_index(draw: Column, slot: Column, seed: int, n: Column) -> Column:
    """Seeded pick in ``0..n-1`` for one slot of one resample, as integer arithmetic any engine has."""
    m = F.lit(DRAW_MODULUS).cast("bigint")
    d, s = draw.cast("bigint"), slot.cast("bigint")
    a = (d * F.lit(DRAW_A) + s * F.lit(DRAW_B) + F.lit(seed * DRAW_SEED).cast("bigint")) % m
    b = (a * a + s) % m
    return ((b * b + d) % m) % n.cast("bigint")


#: Resamples drawn by one task before the next takes over.
DRAWS_PER_TASK = 100


def resample(per_date: DataFrame, cell: Sequence[str], values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Sums of ``values`` over ``n`` dates drawn with replacement, one row per cell and resample.

    A cell holds one row per date, so its sample travels as one array; the resamples are spread over
    tasks in chunks and drawn inside expressions, without a join on (resample, slot).
    """
    packed = per_date.groupBy(*cell).agg(
        F.array_sort(F.collect_list(F.struct("date", *[F.col(v).cast("double").alias(v) for v in values]))).alias("_s")
    )
    chunks = packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_PER_TASK))))
    spread = chunks.repartition(*cell, "_chunk")
    first = F.col("_chunk") * DRAWS_PER_TASK + 1
    drawn = spread.withColumn(
        "draw", F.explode(F.sequence(first, F.least(first + (DRAWS_PER_TASK - 1), F.lit(draws))))
    )
    n = F.size("_s")

    def add(acc: Column, slot: Column) -> Column:
        picked = F.get(F.col("_s"), draw_index(F.col("draw"), slot, seed, n).cast("int"))
        return F.struct(*[(acc[v] + picked[v]).alias(v) for v in values])

    start = F.struct(*[F.lit(0.0).alias(v) for v in values])
    total = F.aggregate(F.sequence(F.lit(0), n - 1), start, add)
    return drawn.select(*cell, "draw", n.alias("dates"), total.alias("_sum")).select(*cell, "draw", "dates", "_sum.*")


def bootstrap_mean_interval(
    per_date: DataFrame, cell: Sequence[str], value: str, *, draws: int = 4000, seed: int = 7, alpha: float = 0.05
) -> DataFrame:
    """Order-index interval of the resampled mean; a single value is its own interval."""
    means = resample(per_date, cell, [value], draws, seed).withColumn("_m", F.col(value) / F.col("dates"))
    ordered = means.groupBy(*cell).agg(F.array_sort(F.collect_list("_m")).alias("_o"))
    low = max(0, int(alpha / 2 * draws))
    high = min(draws - 1, int((1 - alpha / 2) * draws) - 1)
    return ordered.select(*cell, F.get("_o", F.lit(low)).alias("ci_low"), F.get("_o", F.lit(high)).alias("ci_high"))


def date_block_interval(
    events: DataFrame, cell: Sequence[str], *, draws: int = 4000, seed: int = 11, alpha: float = 0.05
) -> DataFrame:
    """Interval of the mean per-date return: whole dates are resampled, so same-day rows stay together."""
    per_date = date_rollup(events, cell)
    each = F.when(F.col("capital") > 0, F.col("pnl") / F.col("capital")).otherwise(0.0)
    return bootstrap_mean_interval(per_date.withColumn("roi", each), cell, "roi", draws=draws, seed=seed, alpha=alpha)


def ratio_bootstrap(per_date: DataFrame, cell: Sequence[str], *, draws: int = 10_000, seed: int = 13) -> DataFrame:
    """Resampled profit and return on capital: linear 2.5/97.5 percentiles and the share at or below zero."""
    out = resample(per_date, cell, ["pnl", "capital"], draws, seed).withColumn(
        "roi", roi(F.col("pnl"), F.col("capital"))
    )
    ends = F.array(F.lit(0.025), F.lit(0.975))
    facts = out.groupBy(*cell).agg(
        F.percentile("pnl", ends).alias("_p"), F.percentile("roi", ends).alias("_r"),
        F.avg((F.col("pnl") <= 0).cast("double")).alias("p_not_positive"),
    )
    return facts.select(
        *cell, F.get("_p", 0).alias("pnl_low"), F.get("_p", 1).alias("pnl_high"), F.get("_r", 0).alias("roi_low"),
        F.get("_r", 1).alias("roi_high"), "p_not_positive",
    )


def event_facts(events: DataFrame, cell: Sequence[str], drawdown_block: Column, order: Sequence[str]) -> DataFrame:
    """Counts, money, distinct dates and stations and drawdown of event returns per cell."""
    each = F.when(F.col("capital") > 0, F.col("pnl") / F.col("capital"))
    known = F.when(F.col("station").isNotNull() & (F.col("station") != "UNKNOWN"), F.col("station"))
    facts = events.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net"),
        F.sum("capital").alias("capital"), F.coalesce(F.avg(each), F.lit(0.0)).alias("mean_roi"),
        F.count_distinct("date").alias("dates"), F.count_distinct(known).alias("stations"),
    )
    falls = max_drawdown(events, cell, order, "pnl", drawdown_block)
    return facts.join(falls, list(cell)).withColumn("losses", F.col("events") - F.col("wins"))


def verdict(
    events: Column, dates: Column, stations: Column, net: Column, mean_roi: Column, low: Column, high: Column
) -> Column:
    return (
        F.when((events < MIN_EVENTS) | (dates < MIN_DATES) | (stations < MIN_STATIONS), "insufficient_data")
        .when((net <= 0) | (mean_roi <= 0) | (high <= 0), "kill")
        .when((dates < DATES_TO_KEEP) | (low <= 0), "provisional")
        .otherwise("keep")
    )


# Why a verdict was given.
REASONS = {
    "few": f"need >= {MIN_EVENTS} events, >= {MIN_DATES} settlement dates, >= {MIN_STATIONS} stations for exploratory read",
    "negative": "negative out-of-sample economics after realistic execution",
    "interval": "95% settlement-date block-bootstrap ROI interval is entirely non-positive",
    "dates": f"positive exploratory economics; need >= {DATES_TO_KEEP} independent settlement dates for KEEP",
    "crosses": "positive point estimate but date-block 95% ROI interval crosses zero",
    "keep": "positive OOS economics with positive date-block bootstrap lower bound and sufficient independent dates",
    "none": "no settled fills",
}


def verdict_reason(
    events: Column, dates: Column, stations: Column, net: Column, mean_roi: Column, low: Column, high: Column
) -> Column:
    """The sentence behind ``verdict``."""
    kind = verdict(events, dates, stations, net, mean_roi, low, high)
    return (
        F.when(kind == "insufficient_data", REASONS["few"])
        .when((kind == "kill") & ((net <= 0) | (mean_roi <= 0)), REASONS["negative"]).when(kind == "kill", REASONS["interval"])
        .when((kind == "provisional") & (dates < DATES_TO_KEEP), REASONS["dates"]).when(kind == "provisional", REASONS["crosses"])
        .otherwise(REASONS["keep"])
    )


def validate(
    rows: DataFrame, cell: Sequence[str], event_keys: Sequence[str], drawdown_block: Column, *, draws: int = 4000
) -> DataFrame:
    """Event roll-up, drawdown, whole-date interval and verdict per cell."""
    events = event_rollup(rows, [*cell, *event_keys])
    facts = event_facts(events, cell, drawdown_block, ["date", *event_keys])
    interval = date_block_interval(events, cell, draws=draws)
    out = facts.join(interval, list(cell))
    c = {n: F.col(n) for n in ("events", "dates", "stations", "net", "mean_roi", "ci_low", "ci_high")}
    judged = {"verdict": verdict(*c.values()), "reason": verdict_reason(*c.values()), "win_rate": F.col("wins") / F.col("events")}
    return out.withColumns(judged)


def rank_strategies(results: DataFrame) -> DataFrame:
    merit = F.lit(-1)
    for name, value in VERDICT_MERIT.items():
        merit = F.when(F.col("verdict") == name, value).otherwise(merit)
    return results.withColumn("merit", merit).orderBy(
        F.desc("merit"), F.desc("ci_low"), F.desc("mean_roi"), F.desc("net")
    )


def robustness(
    per_date: DataFrame, cell: Sequence[str], *, blocks: int = 4, minimum_dates: int = 20, draws: int = 10_000
) -> DataFrame:
    """Enough dates, all blocks and all leave-one-out totals positive, bootstrap low above zero."""
    cell = list(cell)
    dates = per_date.groupBy(*cell).agg(F.count(F.lit(1)).alias("dates"), F.sum("pnl").alias("net"))
    by_block = block_rollup(per_date, cell, blocks).groupBy(*cell).agg(
        F.min((F.col("pnl") > 0).cast("int")).alias("_b"), F.count_if(F.col("pnl") > 0).alias("positive_blocks")
    )
    left_out = leave_one_date_out(per_date, cell).groupBy(*cell).agg(F.min("pnl_without").alias("worst_without"))
    drawn = ratio_bootstrap(per_date, cell, draws=draws)
    out = dates.join(by_block, cell).join(left_out, cell).join(drawn, cell)
    verdict_text = (
        F.when(F.col("dates") < minimum_dates, "INSUFFICIENT_DATES")
        .when(
            (F.col("_b") == 1) & (F.col("worst_without") > 0) & (F.col("roi_low") > 0) & (F.col("p_not_positive") <= 0.05),
            "ROBUST",
        )
        .otherwise("NOT_ROBUST")
    )
    return out.withColumn("robustness", verdict_text).drop("_b")


def scorecard(
    evaluations: DataFrame, signals: DataFrame, fills: DataFrame, settled: DataFrame, marks: DataFrame
) -> DataFrame:
    """Counts, money, drawdown and verdict per strategy from the five facts; a strategy needs only one of them to appear.

    ``signals``: strategy, signal_id, date, station. ``fills``: signal_id, fill_id, filled_at, price, contracts, fee.
    ``settled``: fill_id, pnl. ``marks``: signal_id, horizon, value. The drawdown goes in the order of the fills.
    """
    names = evaluations.select("strategy").union(signals.select("strategy")).distinct()
    tried = evaluations.groupBy("strategy").agg(F.count(F.lit(1)).alias("evaluations"))
    sent = signals.groupBy("strategy").agg(F.count(F.lit(1)).alias("signals"))
    owned = fills.join(signals, "signal_id")
    filled = owned.groupBy("strategy").agg(F.count(F.lit(1)).alias("fills"))
    paid = cut_lineage(owned.join(settled, "fill_id").withColumn("capital", F.col("contracts") * F.col("price") + F.col("fee")))
    money = paid.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("settled"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net"),
        F.sum("capital").alias("capital"),
        F.count_distinct("date").alias("dates"), F.count_distinct(F.nullif("station", F.lit("UNKNOWN"))).alias("stations"),
    )
    moved = marks.where(F.col("value").isNotNull()).join(owned, "signal_id").groupBy("strategy", "horizon").agg(
        F.avg(F.col("value") - F.col("price")).alias("markout")
    ).groupBy("strategy").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "markout")))).alias("markouts")
    )
    falls = max_drawdown(paid, ["strategy"], ["filled_at", "fill_id"], "pnl", time_block("filled_at", 86_400))
    judged = validate(paid, ["strategy"], ["signal_id", "station"], F.unix_date("date")).select("strategy", "verdict", "reason")
    out = names
    for part in (tried, sent, filled, money, moved, falls, judged):
        out = out.join(part, "strategy", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("evaluations", "signals", "fills", "settled", "wins", "dates", "stations")}
    sums = {c: F.coalesce(c, F.lit(0.0)) for c in ("net", "capital", "max_drawdown")}
    texts = {"verdict": F.coalesce("verdict", F.lit("insufficient_data")), "reason": F.coalesce("reason", F.lit(REASONS["none"]))}
    return out.withColumns({**counts, **sums, **texts}).withColumns(
        {"losses": F.col("settled") - F.col("wins"), "roi": roi(F.col("net"), F.col("capital")),
         "win_rate": F.when(F.col("settled") > 0, F.col("wins") / F.col("settled"))}
    )


def mean_markouts(marks: DataFrame, fills: DataFrame) -> DataFrame:
    """Mean executable value minus entry per horizon."""
    return marks.where(F.col("value").isNotNull()).join(fills, "signal_id").groupBy("horizon").agg(
        F.count(F.lit(1)).alias("marks"), F.avg(F.col("value") - F.col("price")).alias("markout")
    )
