"""Ordered computations that survive hot keys.

A window over a key puts all rows of that key into one task. Here an ordered computation runs in
two levels instead: inside (key, block), where a block is a slice of the ordering axis, and over
one summary row per (key, block), whose result is carried back into the blocks. Running sums,
extremes and last values are associative, so the two levels give exactly what one window would.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
#: Default slice of a time axis: a hot key spreads over 144 tasks per day.
BLOCK_SECONDS = 600


def time_block(ts: Column | str, seconds: int = BLOCK_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def value_block(value: Column | str, width: float) -> Column:
    return F.floor(F.col(value) / F.lit(width) if isinstance(value, str) else value / F.lit(width))


def _local(kind: str, expr: Column, window) -> Column:
    if kind == "sum":
        return F.sum(expr).over(window)
    if kind == "max":
        return F.max(expr).over(window)
    if kind == "min":
        return F.min(expr).over(window)
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(window)
    if kind == "first":
        return F.first(expr, ignorenulls=True).over(window)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _total(kind: str, expr: Column, order: Sequence[str], descending: bool) -> Column:
    if kind in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr)
    rank = F.when(expr.isNotNull(), F.struct(*order))
    newest = (kind == "last") != descending
    return F.max_by(expr, rank) if newest else F.min_by(expr, rank)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried) if kind == "last" else F.coalesce(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    block: Column | None,
    *,
    descending: bool = False,
    current: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Add running aggregates from the first row of each key up to the current row.

    ``aggs`` maps a new column to ``(kind, expression)`` with kind sum, max, min, last or first
    (the last two skip nulls). ``block`` must not decrease along ``order``. With ``current=False``
    the current row is left out. ``block=None`` uses one plain window, for keys whose group is
    bounded by nature (levels of one book, dates of one place). ``tasks`` names the tasks that share the blocks.
    """
    keys = list(keys)
    end = Window.currentRow if current else -1

    def ordered(columns):
        return [F.desc(c) if descending else F.asc(c) for c in columns]

    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[_local(k, e, whole).alias(n) for n, (k, e) in aggs.items()])

    sliced = df.withColumn(BLOCK, block)
    if tasks:
        sliced = sliced.repartition(tasks, *keys, BLOCK)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, end)
    local = sliced.select("*", *[_local(k, e, inside).alias(f"_in_{n}") for n, (k, e) in aggs.items()])
    totals = sliced.groupBy(*keys, BLOCK).agg(
        *[_total(k, e, order, descending).alias(f"_all_{n}") for n, (k, e) in aggs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(*ordered([BLOCK])).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, BLOCK, *[_local(k, F.col(f"_all_{n}"), earlier).alias(f"_pre_{n}") for n, (k, _) in aggs.items()]
    )
    joined = local.join(carry, [*keys, BLOCK], "left")
    results = {n: _combine(k, F.col(f"_pre_{n}"), F.col(f"_in_{n}")) for n, (k, _) in aggs.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in results.items()])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, block: Column | None, *, tasks: int | None = None) -> DataFrame:
    """Exact 1-based position of each row within its key."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, block, tasks=tasks)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str], block: Column | None,
    *, following: bool = False,
) -> DataFrame:
    """Columns of the row just before (or after) each row: ``lag``/``lead`` of one, in two levels.

    ``columns`` maps the new name to the source column. Null source values are kept as null.
    """
    packed = F.struct(*[F.col(source).alias(new) for new, source in columns.items()])
    out = running(df, keys, order, {"_prev": ("last", packed)}, block, descending=following, current=False)
    return out.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in columns])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], width: float
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, from counts of distinct values.

    Equal values shrink to one row before the shuffle and the cumulative count runs in value
    blocks of ``width``, so neither many ties nor one huge key land in one task.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("name at least one key; a constant column will do for the whole frame")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [value], {"_upto": ("sum", F.col("_n"))}, value_block(value, width))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    joined = ranked.join(sizes, keys)

    def position(p: float) -> Column:
        return (F.col("_size") - 1) * F.lit(float(p))

    picks = []
    for name, p in probs.items():
        picks.append(F.min(F.when(F.col("_upto") > F.floor(position(p)), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(position(p)), F.col(value))).alias(f"_hi_{name}"))
    picked = joined.groupBy(*keys).agg(*picks, F.max("_size").alias("_size"))
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (position(p) - F.floor(position(p)))
            ).alias(n)
            for n, p in probs.items()
        ],
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, first: bool = False
) -> DataFrame:
    """One whole row per key: the greatest (or least) by ``order``. Combines map-side, unlike a rank."""
    row = F.struct(*df.columns)
    pick = (F.min_by if first else F.max_by)(row, F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def clamped_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], change: str, name: str, block: Column
) -> DataFrame:
    """Running sum that restarts from zero whenever it would go negative.

    With ``C`` the plain running sum, the clamped sum is ``C - min(0, min C so far)``; both ``C``
    and its running minimum are carried between blocks.
    """
    keys = list(keys)
    sliced = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_c", F.sum(change).over(inside)).withColumn("_m", F.min("_c").over(inside))
    totals = local.groupBy(*keys, BLOCK).agg(F.sum(change).alias("_t"), F.min("_m").alias("_low"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_base") + F.col("_low")).over(earlier))
        .select(*keys, BLOCK, "_base", "_floor")
    )
    joined = local.join(carry, [*keys, BLOCK], "left")
    lowest = F.least(F.lit(0), F.col("_floor"), F.col("_base") + F.col("_m"))
    return joined.select(*df.columns, (F.col("_base") + F.col("_c") - lowest).alias(name))


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str, block: Column) -> DataFrame:
    """Worst fall of the running sum below its running peak, which starts at zero; one row per key.

    Each block gives its sum, peak, trough and inner drawdown; an earlier peak can only deepen the
    drawdown to the trough of a later block.
    """
    keys = list(keys)
    sliced = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_e", F.sum(pnl).over(inside)).withColumn("_p", F.max("_e").over(inside))
    per_block = local.groupBy(*keys, BLOCK).agg(
        F.sum(pnl).alias("_t"), F.max("_e").alias("_peak"), F.min("_e").alias("_trough"),
        F.min(F.col("_e") - F.col("_p")).alias("_drop"),
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0))).withColumn(
        "_before", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_peak")).over(earlier))
    )
    worst = F.least(F.col("_drop"), F.col("_base") + F.col("_trough") - F.col("_before"))
    return placed.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(worst)).alias("max_drawdown"))
