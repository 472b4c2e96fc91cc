"""Statistics of earlier days only: residual calibration, rolling quantiles, mid-ranks, effects.

Inputs hold one row per place and day (or hour), so a frame is bounded by the calendar however
many readings stand behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior_days(keys: Sequence[str], day: str, lookback: int | None):
    """Frame of the strictly earlier days, all of them or those within ``lookback``."""
    low = Window.unboundedPreceding if lookback is None else -lookback
    return Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(low, -1)


def residual_calibration(
    df: DataFrame, keys: Sequence[str], day: str, forecast: str, actual: str, *, lookback: int = 90, minimum: int = 30
) -> DataFrame:
    """Prior errors of a forecast: n, mean, median, mean absolute, samples, adjusted value if enough."""
    known = df.where(F.col(forecast).isNotNull() & F.col(actual).isNotNull()).withColumn(
        "_e", F.col(actual) - F.col(forecast)
    )
    w = prior_days(keys, day, lookback)
    out = known.select(
        *df.columns, F.col("_e").alias("raw_error"), F.count("_e").over(w).alias("history_n"),
        F.avg("_e").over(w).alias("bias_mean"), F.percentile("_e", F.lit(0.5)).over(w).alias("bias_median"),
        F.avg(F.abs("_e")).over(w).alias("mae"), F.collect_list("_e").over(w).alias("samples"),
    )
    enough = F.col("history_n") >= minimum
    return out.withColumn("eligible", enough).withColumn(
        "adjusted", F.when(enough, F.col(forecast) + F.col("bias_median"))
    ).withColumn("adjusted_error", F.col(actual) - F.col("adjusted"))


def mid_rank(samples: Column, value: Column) -> Column:
    """Percent of samples below a value, ties counted half; null without samples."""
    below = F.size(F.filter(samples, lambda s: s < value))
    ties = F.size(F.filter(samples, lambda s: s == value))
    return F.when(F.size(samples) > 0, (below + ties * 0.5) * 100.0 / F.size(samples))


def at_most_rank(samples: Column, value: Column) -> Column:
    """Percent of samples at or below a value."""
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda s: s <= value)) * 100.0 / F.size(samples))


def rolling_top_decile(
    df: DataFrame, keys: Sequence[str], day: str, value: str, *, lookback: int, minimum: int
) -> DataFrame:
    """Prior 90 % quantile, mid-rank and top-decile flag; null below the minimum history."""
    w = prior_days(keys, day, lookback)
    seen = df.select(
        "*", F.count(value).over(w).alias("_n"), F.percentile(value, F.lit(0.9)).over(w).alias("_q"),
        F.collect_list(value).over(w).alias("_s"),
    )
    enough = F.col("_n") >= minimum
    rank = F.when(enough, mid_rank(F.col("_s"), F.col(value)))
    return seen.select(
        *df.columns, F.when(enough, F.col("_q")).alias("q90"), rank.alias("percentile"),
        F.coalesce(rank >= 90.0, F.lit(False)).alias("top_decile"),
    )


def robust_z(value: Column, center: Column, mad: Column) -> Column:
    """Distance from the median in robust standard deviations; null when the spread is zero."""
    return F.when(mad != 0, F.lit(0.67448975) * (value - center) / mad)


def fixed_effect_steps(df: DataFrame, place: str, day: str, indicator: str, outcome: str) -> DataFrame:
    """Walk-forward effect of an indicator on an outcome with place effects, per date.

    Least squares with place dummies equals the regression of place-demeaned values. Running sums
    per place are carried to every date and added over places; null with fewer than two marked
    rows or without variation inside a place.
    """
    d, y = F.col(indicator).cast("double"), F.col(outcome)
    sums = df.groupBy(place, day).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(d).alias("sd"), F.sum(y).alias("sy"),
        F.sum(d * y).alias("sdy"), F.sum(d * d).alias("sdd"),
    )
    names = ["n", "sd", "sy", "sdy", "sdd"]
    upto = Window.partitionBy(place).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    state = sums.select(place, day, *[F.sum(c).over(upto).alias(c) for c in names])
    terms = state.select(
        place, day, F.col("sd").alias("marked"),
        (F.col("sdy") - F.col("sd") * F.col("sy") / F.col("n")).alias("cross"),
        (F.col("sdd") - F.col("sd") * F.col("sd") / F.col("n")).alias("square"),
    )
    # The change a place makes on a day; the total over places is then a running sum over days.
    before = Window.partitionBy(place).orderBy(day)
    parts = ["marked", "cross", "square"]
    changes = terms.select(
        day, *[(F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0.0))).alias(c) for c in parts]
    )
    daily = changes.groupBy(day).agg(*[F.sum(c).alias(c) for c in parts])
    # One row per calendar date is left, so this single ordered pass is bounded by the calendar.
    prior = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    total = daily.select(day, *[F.sum(c).over(prior).alias(c) for c in parts])
    return total.select(
        day, F.when((F.col("marked") >= 2) & (F.col("square") > 1e-9), F.col("cross") / F.col("square")).alias("effect")
    )
