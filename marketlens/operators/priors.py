"""Joins that can only see earlier dates."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from marketlens.functions.contracts import contains

# Functions of this module travel to the Python workers by value: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def prior_samples(history: DataFrame, keys: Sequence[str], day: str, value: str, usable: Column) -> DataFrame:
    """Per place and day the array of usable values of all strictly earlier days.

    ``history`` holds one row per place and day: an array is no longer than the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    return history.select(*keys, day, F.collect_list(F.when(usable, F.col(value))).over(w).alias("samples"))


def empirical_probability(
    samples: Column, base: Column, shape: Column, lower: Column, upper: Column, minimum: int, *, inclusive: bool = False
) -> Column:
    """Share of ``base + sample`` inside a contract; null below the minimum number of samples."""
    inside = F.size(
        F.filter(samples, lambda s: contains(shape, lower, upper, base + s, inclusive=inclusive, on_bad="false"))
    )
    return F.when(base.isNotNull() & (F.size(samples) >= minimum), inside / F.size(samples))


def posterior(
    rows: DataFrame, history: DataFrame, keys: Sequence[str], day: str, *, value: str, usable: Column, minimum: int,
    base: str = "high", shape: str = "shape", lower: str = "lower", upper: str = "upper",
) -> DataFrame:
    """Probability of each row's contract from earlier settlement differences of its place.

    Rows repeat the same few (place, day, base, contract) values over and over, so the probability is
    computed once per distinct combination and joined back.
    """
    question = [*keys, day, base, shape, lower, upper]
    asked = rows.select(*question).distinct().join(
        prior_samples(history, keys, day, value, usable), [*keys, day], "left"
    )
    none = F.array().cast("array<double>")
    samples = F.coalesce(F.col("samples"), none)
    answered = asked.select(
        *[F.col(c).alias(f"_q_{c}") for c in question], F.size(samples).alias("prior_n"),
        empirical_probability(samples, F.col(base), F.col(shape), F.col(lower), F.col(upper), minimum).alias("p_yes"),
    )
    same = [rows[c].eqNullSafe(answered[f"_q_{c}"]) for c in question]
    return rows.join(answered, same, "left").drop(*[f"_q_{c}" for c in question])


#: Scales of the distance between surface states.
NEIGHBOUR_SCALES = {
    "hour": 1.5, "high": 10.0, "minutes_since_high": 60.0, "drop": 1.0, "slope": 0.04, "dewpoint_depression": 8.0,
}


def _scaled(gaps: np.ndarray) -> np.ndarray:
    """Root mean square of scaled gaps along the last axis, NaN where a side lacks the feature; infinite without any."""
    known = ~np.isnan(gaps)
    used = known.sum(axis=-1)
    total = np.where(known, gaps * gaps, 0.0).sum(axis=-1)
    return np.where(used > 0, np.sqrt(total / np.maximum(used, 1)), np.inf)


def _least(state: np.ndarray, block: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Per state a number not above its scaled distance to any row of the block, from the block's ranges.

    A feature counts with its gap to the range if all rows of the block have it, and in the divisor if any row has it.
    """
    have = ~np.isnan(block)
    some, every = have.any(axis=0), have.all(axis=0)
    low, high = np.where(have, block, np.inf).min(axis=0), np.where(have, block, -np.inf).max(axis=0)
    known = ~np.isnan(state)
    gap = np.where(known & every, np.maximum(0.0, np.maximum(low - state, state - high)) / scales, 0.0)
    used = (known & some).sum(axis=1)
    return np.where(used > 0, np.sqrt((gap * gap).sum(axis=1) / np.maximum(used, 1)) * (1 - 1e-12), np.inf)


def nearest_states(
    day: np.ndarray, state: np.ndarray, past_day: np.ndarray, past: np.ndarray, scales: np.ndarray, k: int, block_days: int
) -> np.ndarray:
    """Per state the numbers of its k nearest past rows of strictly earlier days, nearest first, -1 where there are fewer.

    Past rows come in the order that decides ties, and go in blocks of days, the latest block first. A list of k is kept per state; a block whose
    lower bound exceeds the last distance of a full list is passed over, another one is measured and merged.
    """
    n, rows = len(day), np.arange(len(past_day))
    near, number = np.full((n, k), np.inf), np.full((n, k), len(rows))
    slot = past_day // block_days
    for one in np.unique(slot)[::-1]:
        mine = rows[slot == one]
        asks = np.flatnonzero(day > past_day[mine].min())
        full = number[asks, -1] < len(rows)
        if full.any():
            asks = np.append(asks[~full], asks[full][_least(state[asks[full]], past[mine], scales) <= near[asks[full], -1]])
        for at in range(0, len(asks), 1024):
            some = asks[at : at + 1024]
            far = _scaled((state[some, None, :] - past[None, mine, :]) / scales)
            early = past_day[mine][None, :] < day[some, None]
            both = np.concatenate([near[some], np.where(early, far, np.inf)], axis=1)
            which = np.concatenate([number[some], np.where(early, mine[None, :], len(rows))], axis=1)
            # no row at all sorts behind rows at an infinite distance
            best = np.lexsort((which, both), axis=-1)[:, :k]
            near[some], number[some] = np.take_along_axis(both, best, 1), np.take_along_axis(which, best, 1)
    return np.where(number < len(rows), number, -1)


def _paired(
    day: np.ndarray, hour: np.ndarray, state: np.ndarray, first: np.ndarray, count: np.ndarray, past_day: np.ndarray, past_hour: np.ndarray, past: np.ndarray,
    scales: np.ndarray, k: int, max_hour_gap: int, pairs: int = 1_000_000,
) -> np.ndarray:
    """As :func:`nearest_states` for states of many small places at once: each asks the ``count`` past rows from ``first`` on, some pairs at a time."""
    out, upto, at = np.full((len(day), k), -1), np.cumsum(count), 0
    while at < len(day):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, side="right")))
        row = np.repeat(np.arange(at, end), count[at:end])
        col = np.arange(len(row)) + np.repeat(first[at:end] - (upto[at:end] - count[at:end] - (upto[at - 1] if at else 0)), count[at:end])
        good = (past_day[col] < day[row]) & (np.abs(past_hour[col] - hour[row]) <= max_hour_gap)
        row, col = row[good], col[good]
        order = np.lexsort((col, _scaled((state[row] - past[col]) / scales), row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out[row[rank < k], rank[rank < k]] = col[rank < k]
        at = end
    return out


#: Rows of a group of places, and past rows from which a place is folded block by block.
GROUP_ROWS, LARGE_PLACE = 4000, 512


def nearest_prior(
    current: DataFrame, history: DataFrame, place: str, day: str, features: Mapping[str, float], *,
    tie: Sequence[str], k: int = 80, minimum: int = 30, max_hour_gap: int = 2, block_days: int = 32, group_days: int = 366,
) -> DataFrame:
    """The ``k`` nearest earlier states of the same place and a close hour, and their residuals.

    Rows meet per group of places and span of ``group_days``; a past row goes to its own span and to each later one. There are as many groups as
    the rows ask for, and one row stands for one place, day and hour, so a group is bounded by the calendar whatever the place. Inside a group small
    places are measured together, on arrays, and for large ones bounded lists are merged block by block; pairs are never rows. A feature that is NaN counts
    as missing; ties of distance go by the ``tie`` columns; rows without place, day or hour have no neighbours.
    """
    names, scales = list(features), np.array([features[f] for f in features])
    number = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, f in enumerate(names)]
    span = F.floor(F.unix_date(day) / group_days)
    last, rows = current.agg(F.max(span), F.count(F.lit(1))).first()
    last, groups = F.lit(last).cast("long"), F.lit(-(-rows // GROUP_ROWS) or 1)
    now = current.select("*", span.alias("_span"), F.unix_date(day).alias("_day"), F.pmod(F.xxhash64(place), groups).alias("_group"), *number)
    past = history.where(F.col("residual").isNotNull() & F.col(place).isNotNull() & F.col("hour").isNotNull() & (span <= last)).select(
        F.col(place).alias("_place"), F.pmod(F.xxhash64(place), groups).alias("_group"), F.unix_date(day).alias("_day"), F.col("hour").cast("long").alias("_hour"), *number,
        F.col("residual").cast("double").alias("_residual"),
        F.struct(*[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)]).alias("_tie"), F.explode(F.sequence(span, last)).alias("_span"),
    )

    def matrix(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(f"_f{i}").to_numpy() for i in range(len(names))], axis=1)

    kept = current.columns

    def group(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.flatten()
        theirs = theirs.take(pc.sort_indices(theirs, [(f"_tie.t{i}", "ascending") for i in range(len(tie))]))
        names_ = pa.chunked_array([*mine.column(place).chunks, *theirs.column("_place").chunks], theirs.schema.field("_place").type)
        code = pc.fill_null(names_.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        own, past_own = code[: len(mine)], code[len(mine) :]
        order = np.argsort(past_own, kind="stable")
        theirs, past_own = theirs.take(pa.array(order)), past_own[order]
        hour, past_hour = pc.fill_null(mine.column("hour").cast("int64"), -1_000_000).to_numpy(), theirs.column("_hour").to_numpy()
        day_, past_day = pc.fill_null(mine.column("_day").cast("int64"), -1_000_000).to_numpy(), theirs.column("_day").cast("int64").to_numpy()
        state, past_state, residual = matrix(mine), matrix(theirs), theirs.column("_residual").to_numpy()
        first = np.searchsorted(past_own, own)
        count = np.searchsorted(past_own, own, side="right") - first
        near, small = np.full((len(mine), k), -1), np.flatnonzero(count < LARGE_PLACE)
        near[small] = _paired(day_[small], hour[small], state[small], first[small], count[small], past_day, past_hour, past_state, scales, k, max_hour_gap)
        for one in np.unique(own[count >= LARGE_PLACE]):
            asks, there = np.flatnonzero(own == one), np.flatnonzero(past_own == one)
            for h in np.unique(hour[asks]):
                rows, close = asks[hour[asks] == h], there[np.abs(past_hour[there] - h) <= max_hour_gap]
                if len(close):
                    best = nearest_states(day_[rows], state[rows], past_day[close], past_state[close], scales, k, block_days)
                    near[rows] = np.where(best >= 0, close[best], -1)
        found = np.full((len(mine), k), np.nan)
        found[near >= 0] = residual[near[near >= 0]]
        found = np.sort(found, axis=1)  # NaN last
        n = (~np.isnan(found)).sum(axis=1)
        at = np.arange(len(mine))
        middle = (found[at, np.maximum((n - 1) // 2, 0)] + found[at, np.minimum(n // 2, k - 1)]) / 2
        enough = n >= max(minimum, 1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32(), mask=np.append(n == 0, False)), pa.array(found[~np.isnan(found)]))
        columns = [pa.array(n), lists, pa.array(middle, mask=~enough), pa.array((found <= 0).sum(axis=1) / np.maximum(n, 1), mask=~enough)]
        out = mine.select(kept)
        for name, column in zip(("neighbours", "residuals", "median_residual", "terminal_probability"), columns, strict=True):
            out = out.append_column(name, column)
        return out

    schema = StructType(list(current.schema.fields)).add("neighbours", LongType()).add("residuals", ArrayType(DoubleType()))
    schema = schema.add("median_residual", DoubleType()).add("terminal_probability", DoubleType())
    return now.groupBy("_group", "_span").cogroup(past.groupBy("_group", "_span")).applyInArrow(group, schema)
