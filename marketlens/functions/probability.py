"""Probabilities of contracts under Gaussian and heuristic models."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, absolute error of erf below 1.5e-7.
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

#: Two floors of the standard deviation, kept apart by name.
SIGMA_FLOOR_NARROW = 0.15
SIGMA_FLOOR_WIDE = 0.75


def erf(x: Column) -> Column:
    magnitude = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * magnitude)
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFICIENTS):
        poly = t * (F.lit(a) + poly)
    tail = F.lit(1.0) - poly * F.exp(-magnitude * magnitude)
    return F.when(x < 0, -tail).otherwise(tail)


def normal_cdf(x: Column, mean: Column, sigma: Column, floor: float) -> Column:
    sd = F.greatest(F.lit(floor), sigma)
    return F.lit(0.5) * (F.lit(1.0) + erf((x - mean) / (sd * F.lit(2.0**0.5))))


def unit(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def gaussian_bucket(mean: Column, sigma: Column, low: Column, high: Column) -> Column:
    top = normal_cdf(high + 0.5, mean, sigma, SIGMA_FLOOR_NARROW)
    return unit(top - normal_cdf(low - 0.5, mean, sigma, SIGMA_FLOOR_NARROW))


def gaussian_above(mean: Column, sigma: Column, threshold: Column) -> Column:
    return unit(F.lit(1.0) - normal_cdf(threshold - 0.5, mean, sigma, SIGMA_FLOOR_NARROW))


def gaussian_below(mean: Column, sigma: Column, threshold: Column) -> Column:
    return unit(normal_cdf(threshold + 0.5, mean, sigma, SIGMA_FLOOR_NARROW))


def strike_probability(
    strike: Column, floor_strike: Column, cap_strike: Column, mean: Column, sigma: Column,
    *, sigma_floor: float = SIGMA_FLOOR_WIDE, on_bad: str = "error",
) -> Column:
    """Probability of an exact strike; an unknown strike is an error, null or zero (``on_bad``)."""
    name = F.lower(strike)
    between = (name == "between") & floor_strike.isNotNull() & cap_strike.isNotNull()
    less = (name == "less") & cap_strike.isNotNull()
    greater = (name == "greater") & floor_strike.isNotNull()
    top = F.when(between, cap_strike + 0.5).when(less, cap_strike - 0.5)
    bottom = F.when(between, floor_strike - 0.5).when(greater, floor_strike + 0.5)
    upto = F.coalesce(normal_cdf(top, mean, sigma, sigma_floor), F.lit(1.0))
    below = F.coalesce(normal_cdf(bottom, mean, sigma, sigma_floor), F.lit(0.0))
    bad = {
        "error": F.raise_error(F.lit("unsupported strike")).cast("double"),
        "null": F.lit(None).cast("double"),
        "zero": F.lit(0.0),
    }[on_bad]
    known = (between | less | greater) & mean.isNotNull() & sigma.isNotNull()
    return F.when(known, unit(upto - below)).otherwise(bad)


def provisional_probability(in_bucket: Column, locked: Column, drop: Column, slope: Column) -> Column:
    """Capped heuristic: even odds unless locked, then a base with two bounded bonuses."""
    drop_bonus = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(0.06), (drop - 1.0) * 0.02)), F.lit(0.0))
    slope_bonus = F.when(slope < 0, F.least(F.lit(0.04), -slope * 2.0)).otherwise(0.0)
    inside = F.greatest(F.lit(0.5), F.least(F.lit(0.94), F.lit(0.84) + drop_bonus + slope_bonus))
    return F.when(~locked, F.lit(0.5)).when(in_bucket, inside).otherwise(F.lit(1.0) - inside)
