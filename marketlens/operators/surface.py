"""What was known about a station at a time: daily extremes, causal state, gates, quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.asof import asof_backward, asof_forward
from marketlens.operators.ordered import previous_row, running, time_block

#: A station-day is cut into hours, so one crowded day is not one task.
HOUR = 3600


def daily_extreme(obs: DataFrame, keys: Sequence[str] = ("station", "day"), kind: str = "max") -> DataFrame:
    """Extreme, count and last time of the extreme per settlement day."""
    pick = F.max if kind == "max" else F.min
    signed = F.col("temp") if kind == "max" else -F.col("temp")
    return obs.where(F.col("temp").isNotNull()).groupBy(*keys).agg(
        pick("temp").alias("extreme"), F.count(F.lit(1)).alias("n"),
        F.max(F.struct(signed.alias("s"), F.col("valid_time").alias("t")))["t"].alias("extreme_time"),
    )


def reconstruction_residual(extreme: DataFrame, official: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Official minus rebuilt value, whether they agree exactly and within one degree."""
    gap = F.col("official") - F.col("extreme")
    return extreme.join(official, list(keys)).select(
        "*", gap.alias("residual"), (F.abs(gap) < 1e-9).alias("exact"), (F.abs(gap) <= 1.0).alias("within_one")
    )


def extreme_times(obs: DataFrame, keys: Sequence[str] = ("station", "day"), kind: str = "max") -> DataFrame:
    """Every reading that ties for the extreme, in long form."""
    best = obs.groupBy(*keys).agg((F.max if kind == "max" else F.min)("temp").alias("extreme"))
    return obs.join(best, list(keys)).where(F.col("temp") == F.col("extreme"))


def causal_state(
    obs: DataFrame, targets: DataFrame, at: str, keys: Sequence[str] = ("station", "day"),
    *, extra: Sequence[str] = (), slope_seconds: int = 900,
) -> DataFrame:
    """State of each target from the readings at or before it, within the same settlement day.

    Adds high, latest, latest_time, last_high_time, minutes_since_high, drop, slope (per minute,
    first to last reading of the look-back) and n. ``extra`` columns come along from the last
    reading that has them. A high that occurs again counts from its last occurrence: the running
    maximum is taken over (value, time).
    """
    axis = {"_t": F.col("valid_time"), "_rank": F.lit(0), "_seq": F.col("seq")}
    readings = obs.where(F.col("temp").isNotNull()).select(
        *keys, *[c.alias(n) for n, c in axis.items()],
        F.struct(F.col("temp").alias("v"), F.col("valid_time").alias("t")).alias("_reading"),
        *[F.col(c).alias(f"_x_{c}") for c in extra],
    )
    asked = targets.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_rank"), F.lit(None).cast("bigint").alias("_seq"),
        F.struct(*targets.columns).alias("_target"),
    )
    state = running(
        readings.unionByName(asked, allowMissingColumns=True), keys, ["_t", "_rank", "_seq"],
        {
            "_hi": ("max", F.col("_reading")), "_last": ("last", F.col("_reading")),
            "n": ("sum", F.col("_reading").isNotNull().cast("bigint")),
            **{f"_last_{c}": ("last", F.col(f"_x_{c}")) for c in extra},
        },
        time_block("_t", HOUR),
    ).where(F.col("_target").isNotNull())
    flat = state.select(
        "_target.*", F.col("_hi.v").alias("high"), F.col("_hi.t").alias("last_high_time"),
        F.col("_last.v").alias("latest"), F.col("_last.t").alias("latest_time"), "n",
        *[F.col(f"_last_{c}").alias(c) for c in extra],
    )
    minutes = (F.unix_micros(at) - F.unix_micros("last_high_time")) / F.lit(6e7)
    known = flat.withColumn("minutes_since_high", minutes).withColumn("drop", F.col("high") - F.col("latest"))
    return with_slope(obs, known, at, keys, slope_seconds)


def with_slope(
    obs: DataFrame, states: DataFrame, anchor: str, keys: Sequence[str], seconds: int, name: str = "slope",
    value: str = "temp",
) -> DataFrame:
    """Per-minute change from the first reading of ``[anchor - seconds, anchor]`` to the latest one.

    The first reading of the look-back is the first one at or after ``anchor - seconds``: a forward
    as-of join, linear however crowded the look-back is. Null without two distinct times.
    """
    shifted = states.withColumn("_from", F.timestamp_micros(F.unix_micros(anchor) - F.lit(seconds * 1_000_000)))
    first = asof_forward(
        shifted,
        obs.where(F.col(value).isNotNull()).select(
            *keys, F.col("valid_time").alias("_first_time"), F.col(value).alias("_first"), F.col("seq").alias("_fseq")
        ),
        keys, "_from", "_first_time", ["_first_time", "_first"], right_tie=["_fseq"], block_seconds=HOUR,
    )
    span = (F.unix_micros("latest_time") - F.unix_micros("_first_time")) / F.lit(6e7)
    return first.withColumn(name, F.when(span > 0, (F.col("latest") - F.col("_first")) / span)).drop(
        "_from", "_first_time", "_first"
    )


def latest_change_rate(
    obs: DataFrame, keys: Sequence[str], value: str, *, seconds: int = 900, name: str = "rate"
) -> DataFrame:
    """Change per minute over the look-back before each key's latest reading."""
    usable = obs.where(F.col(value).isNotNull())
    latest = usable.groupBy(*keys).agg(
        F.max(F.struct("valid_time", "seq", F.col(value).alias("v"))).alias("_l"), F.count(F.lit(1)).alias("n")
    ).select(*keys, F.col("_l.valid_time").alias("latest_time"), F.col("_l.v").alias("latest"), "n")
    return with_slope(usable, latest, "latest_time", keys, seconds, name, value)


#: Thresholds of the standard gate.
GATE = {"minutes": 60.0, "drop": 1.0, "slope": 0.02}


def gate_reasons(
    high: Column, latest: Column, minutes: Column, drop: Column, slope: Column, *,
    min_minutes: Column | float = GATE["minutes"], min_drop: Column | float = GATE["drop"],
    max_slope: Column | float = GATE["slope"], require_slope: bool = False,
) -> Column:
    """Ordered reasons why a high is not yet locked; an empty array passes."""
    missing_slope = F.when(slope.isNull(), "SLOPE_UNAVAILABLE") if require_slope else F.lit(None).cast("string")
    reasons = F.array(
        F.when(high.isNull() | latest.isNull(), "NO_SURFACE_DATA"),
        F.when(minutes.isNull() | (minutes < min_minutes), "HIGH_NOT_STALE_ENOUGH"),
        F.when(drop.isNull() | (drop < min_drop), "INSUFFICIENT_DROP_FROM_HIGH"),
        missing_slope,
        F.when(slope > max_slope, "TEMPERATURE_STILL_RISING"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


#: Operational guards of a temperature series.
QUALITY = {
    "min_temp": -90.0, "max_temp": 140.0, "max_jump": 2.5, "gap_warn": 10.0, "gap_fail": 30.0,
    "flat_warn": 120.0, "flat_fail": 240.0, "stale_warn": 10.0, "stale_fail": 30.0,
}


def series_quality(
    obs: DataFrame, as_of: DataFrame, keys: Sequence[str] = ("station", "day"), limits: Mapping[str, float] = QUALITY
) -> DataFrame:
    """PASS/WARN/FAIL with ordered reasons per key. ``as_of`` holds the keys and an ``as_of`` time.

    Keys without a usable reading fail. The flat run reaches back from the latest reading to the
    first one after the last differing value, found by two plain aggregates.
    """
    keys = list(keys)
    seen = obs.where(F.col("temp").isNotNull()).join(as_of, keys).where(F.col("valid_time") <= F.col("as_of"))
    stepped = previous_row(
        seen.select(*keys, "valid_time", "seq", "temp"), keys, ["valid_time", "seq"],
        {"_pt": "valid_time", "_pv": "temp"}, time_block("valid_time", HOUR),
    )
    gap = (F.unix_micros("valid_time") - F.unix_micros("_pt")) / F.lit(6e7)
    jump = F.when(gap > 0, F.abs(F.col("temp") - F.col("_pv")) / gap)
    facts = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(gap == 0).alias("duplicate"),
        F.max((F.col("temp") < limits["min_temp"]) | (F.col("temp") > limits["max_temp"])).alias("out_of_range"),
        F.coalesce(F.max(F.when(gap > 0, gap)), F.lit(0.0)).alias("max_gap"),
        F.coalesce(F.max(jump), F.lit(0.0)).alias("max_jump"),
        F.max(F.struct("valid_time", "seq", "temp")).alias("_latest"),
    )
    latest = facts.select(*keys, F.col("_latest.valid_time").alias("_lt"), F.col("_latest.temp").alias("_lv"))
    against = seen.join(latest, keys)
    differing = against.where(F.abs(F.col("temp") - F.col("_lv")) > 1e-12).groupBy(*keys).agg(
        F.max(F.struct("valid_time", "seq")).alias("_change")
    )
    run = against.join(differing, keys, "left").where(
        F.col("_change").isNull() | (F.struct("valid_time", "seq") > F.col("_change"))
    ).groupBy(*keys).agg(F.min("valid_time").alias("_flat_from"))
    table = as_of.join(facts, keys, "left").join(run, keys, "left")
    age = F.greatest(F.lit(0.0), (F.unix_micros("as_of") - F.unix_micros("_latest.valid_time")) / F.lit(6e7))
    flat = (F.unix_micros("_latest.valid_time") - F.unix_micros("_flat_from")) / F.lit(6e7)
    g = limits
    codes = F.array(
        F.when(F.col("n").isNull(), "NO_VALID_TEMPERATURE"),
        F.when(F.coalesce(F.col("duplicate"), F.lit(False)), "DUPLICATE_TIMESTAMP"),
        F.when(F.col("out_of_range"), "TEMPERATURE_OUT_OF_RANGE"),
        F.when(F.col("max_gap") > g["gap_fail"], "OBSERVATION_GAP_FAIL").when(
            F.col("max_gap") > g["gap_warn"], "OBSERVATION_GAP_WARN"),
        F.when(F.col("max_jump") > g["max_jump"], "IMPLAUSIBLE_TEMPERATURE_JUMP"),
        F.when(age > g["stale_fail"], "STALE_STATION_FAIL").when(age > g["stale_warn"], "STALE_STATION_WARN"),
        F.when(flat >= g["flat_fail"], "TEMPERATURE_FLATLINE_FAIL").when(
            flat >= g["flat_warn"], "TEMPERATURE_FLATLINE_WARN"),
    )
    out = table.withColumn("reasons", F.filter(codes, lambda r: r.isNotNull()))
    failing = F.exists(
        "reasons",
        lambda r: r.endswith("_FAIL")
        | r.isin("NO_VALID_TEMPERATURE", "TEMPERATURE_OUT_OF_RANGE", "IMPLAUSIBLE_TEMPERATURE_JUMP"),
    )
    status = F.when(failing, "FAIL").when(F.size("reasons") > 0, "WARN").otherwise("PASS")
    return out.select(
        *keys, status.alias("status"), "reasons", F.coalesce("max_gap", F.lit(0.0)).alias("max_gap"),
        F.coalesce("max_jump", F.lit(0.0)).alias("max_jump"), F.coalesce(flat, F.lit(0.0)).alias("flat_minutes"),
        F.when(F.col("n").isNotNull(), age).alias("age_minutes"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def hourly_targets(days: DataFrame, hours: Sequence[int], start: Column) -> DataFrame:
    """One target per settlement day and local hour; ``start`` is the UTC start of the day."""
    grid = days.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    return grid.withColumn("at", F.timestamp_micros(F.unix_micros(start) + F.col("hour").cast("bigint") * 3_600_000_000))


__all__ = [
    "asof_backward", "causal_state", "daily_extreme", "extreme_times", "gate_reasons", "hourly_targets",
    "latest_change_rate", "reconstruction_residual", "series_quality", "with_slope", "GATE", "QUALITY",
]
