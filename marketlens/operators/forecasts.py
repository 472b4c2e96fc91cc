"""Forecast blends and studies: ensembles, nowcasts, panels, hit studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.probability import SIGMA_FLOOR_WIDE
from marketlens.operators.rolling import robust_z


def ensemble_distribution(df: DataFrame, keys: Sequence[str], member: str, value: str) -> DataFrame:
    """Maximum per member, then mean and floored population spread over members."""
    tops = df.groupBy(*keys, member).agg(F.max(value).alias("_top"))
    return tops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.avg("_top").alias("mean"),
        F.greatest(F.lit(SIGMA_FLOOR_WIDE), F.coalesce(F.stddev_pop("_top"), F.lit(0.0))).alias("sigma"),
    )


def station_trend(current: DataFrame, previous: DataFrame, key: str, *, low_h: float = 0.03, high_h: float = 1.5) -> DataFrame:
    """Degrees per hour between two readings of each key whose distance is in range.

    Both frames hold key, ts, temp.
    """
    old = previous.select(key, F.col("ts").alias("_pt"), F.col("temp").alias("_pv"))
    hours = (F.unix_micros("ts") - F.unix_micros("_pt")) / F.lit(3.6e9)
    both = current.join(old, key).withColumn("_h", hours).where(F.col("_h").between(low_h, high_h))
    return both.select(key, ((F.col("temp") - F.col("_pv")) / F.col("_h")).alias("slope"))


def trend_summary(slopes: DataFrame, group: Sequence[str]) -> DataFrame:
    return slopes.groupBy(*group).agg(
        F.avg("slope").alias("trend"), F.coalesce(F.stddev_pop("slope"), F.lit(0.0)).alias("dispersion"),
        F.count(F.lit(1)).alias("slopes"),
    )


def blend(forecasts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inverse-variance mean and floored mean spread of the forecasts of a key."""
    w = F.lit(1.0) / F.pow(F.greatest(F.col("sigma"), F.lit(SIGMA_FLOOR_WIDE)), 2)
    return forecasts.groupBy(*key).agg(
        (F.sum(F.col("mean") * w) / F.sum(w)).alias("forecast_mean"),
        F.greatest(F.lit(SIGMA_FLOOR_WIDE), F.avg("sigma")).alias("forecast_sigma"),
    )


def nowcast(anchors: DataFrame, trends: DataFrame, blends: DataFrame, key: str, now: Column) -> DataFrame:
    """Estimate now, projected high, spread and confidence from the official anchor.

    ``anchors``: key, observed_at, temp. Missing trends count as flat, missing forecasts as persistence.
    """
    t = anchors.join(trends, key, "left").join(blends, key, "left")
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("observed_at")) / F.lit(6e7))
    trend = F.coalesce("trend", F.lit(0.0))
    t = t.withColumns({"_age": age, "_trend": trend})
    shift = F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col("_trend") * F.least(F.col("_age") / 60.0, F.lit(0.5))))
    t = t.withColumn("_now", F.col("temp") + shift)
    t = t.withColumns({
        "_mean": F.coalesce("forecast_mean", "_now"), "_sig": F.coalesce("forecast_sigma", F.lit(2.0)),
        "_w": F.least(F.lit(0.55), F.lit(0.12) + F.col("_age") / 120.0),
    })
    high = F.greatest(F.col("temp"), (1 - F.col("_w")) * F.col("_now") + F.col("_w") * F.col("_mean"))
    spread = (
        F.lit(0.55) + F.lit(0.20) * F.col("_sig") + F.lit(0.18) * F.abs(F.col("_mean") - F.col("_now"))
        + F.lit(0.08) * F.when(F.coalesce("slopes", F.lit(0)) > 1, F.col("dispersion")).otherwise(0.0)
    )
    t = t.withColumns({"_high": high, "_sigma": F.greatest(F.lit(0.55), F.least(F.lit(4.0), spread))})
    confidence = F.exp(-0.35 * F.col("_sigma")) * F.exp(-0.01 * F.col("_age"))
    return t.select(
        key, F.col("_now").alias("estimated_now"), F.col("_high").alias("projected_high"), F.col("_sigma").alias("sigma"),
        F.col("_trend").alias("trend"), F.col("_mean").alias("forecast_mean"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
    )


def activity_panel(today: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Each metric of today against its matched baseline days: mean, median, share at most, robust z.

    One row per key today, one row per key and day in the baseline: the values of a key are an array no longer than the calendar, met in one join.
    """

    def median(values: Column) -> Column:
        place = (F.size(values) - 1) * F.lit(0.5)
        low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    def at_most(values: Column, now: Column) -> Column:
        return F.filter(values, lambda v: v <= now)

    def gaps(values: Column, middle: Column) -> Column:
        return F.transform(values, lambda v: F.abs(v - middle))

    matched = baseline.groupBy(key).agg(
        F.count(F.lit(1)).alias("baseline_days"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.collect_list(m).alias(f"_{m}_days") for m in metrics]
    )
    out = today.select(key, *metrics).join(matched, key, "left")
    for m in metrics:
        days = F.col(f"_{m}_days")
        out = out.withColumn(f"{m}_pct", F.when((F.size(days) > 0) & F.col(m).isNotNull(), F.size(at_most(days, F.col(m))) / F.size(days) * 100.0))
        out = out.withColumn(f"{m}_median", F.when(F.size(days) > 0, median(F.array_sort(days))))
        out = out.withColumn("_mad", median(F.array_sort(gaps(days, F.col(f"{m}_median")))))
        out = out.withColumn(f"{m}_z", robust_z(F.col(m), F.col(f"{m}_median"), F.col("_mad"))).drop("_mad", f"_{m}_days")
    ranks = F.array_sort(F.filter(F.array(*[F.col(f"{m}_pct") for m in metrics]), lambda v: v.isNotNull()))
    n = F.size(ranks)
    middle = (F.get(ranks, F.floor((n - 1) / 2).cast("int")) + F.get(ranks, F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("activity_pct", F.when(n > 0, middle))


def hit_study(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hits of the most probable and of the current bucket, error and mean winner probability per group.

    ``rows``: one per contract with p, in_now, won, case columns and forecast_error per case.
    """
    by_case = rows.groupBy(*group, "case").agg(
        F.max_by("won", F.struct("p", -F.col("pos"))).alias("top_hit"), F.max((F.col("in_now") & F.col("won"))).alias("current_hit"),
        F.sum(F.when(F.col("won"), F.col("p")).otherwise(0.0)).alias("winner_p"), F.max("abs_error").alias("abs_error"),
    )
    return by_case.groupBy(*group).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("top_hit").alias("top_hits"), F.count_if("current_hit").alias("current_hits"),
        F.avg("abs_error").alias("mae"), F.avg("winner_p").alias("mean_winner_p"),
    )


def adjustment_study(rows: DataFrame) -> DataFrame:
    """Baseline against adjusted ladders: hits, corrected, harmed, mean change of the winner's probability.

    ``rows``: one per contract with case, date, pos, base_p, adj_p, won, error.
    """
    by_case = rows.groupBy("case", "date").agg(
        F.max_by("won", F.struct("base_p", -F.col("pos"))).alias("base_hit"),
        F.max_by("won", F.struct("adj_p", -F.col("pos"))).alias("adj_hit"),
        F.sum(F.when(F.col("won"), F.col("adj_p") - F.col("base_p")).otherwise(0.0)).alias("change"), F.max("error").alias("error"),
    )
    return by_case.agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("date").alias("dates"), F.avg("error").alias("mean_error"),
        F.count_if("base_hit").alias("base_hits"), F.count_if("adj_hit").alias("adj_hits"),
        F.count_if(~F.col("base_hit") & F.col("adj_hit")).alias("corrected"),
        F.count_if(F.col("base_hit") & ~F.col("adj_hit")).alias("harmed"), F.avg("change").alias("mean_change"),
    )
