"""Transparent physical scores: model against observation, and convective cooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.geo import angular_difference_deg
from marketlens.functions.numbers import clip

#: Weights of the five components.
DELTA_WEIGHTS = {"solar": 0.38, "velocity": 0.24, "error": 0.23, "cloud": 0.10, "pressure": 0.05}


def peak_factor(hours_to_peak: Column) -> Column:
    ahead = clip(F.lit(0.35) + F.lit(0.65) * (F.lit(1.0) - F.exp(-hours_to_peak / 2.0)), 0.35, 1.0)
    return F.when(hours_to_peak >= 0, ahead).otherwise(clip(F.exp(hours_to_peak / 2.0), 0.10, 1.0))


def delta_score(
    transmission: Column, cloud_cover_pct: Column, observed_f: Column, model_f: Column, velocity: Column,
    cold_fraction: Column, pressure_velocity: Column, hours_to_peak: Column, age_minutes: Column,
) -> Column:
    """Struct (value, confidence, components, label). A missing input adds zero and costs confidence."""
    peak = peak_factor(hours_to_peak)
    expected = clip(F.lit(1.0) - F.lit(0.75) * clip(cloud_cover_pct / 100.0, 0, 1), 0.05, 1.0)
    parts = {
        "solar": F.when(
            transmission.isNotNull() & cloud_cover_pct.isNotNull(), clip((transmission - expected) / 0.35, -1, 1) * peak
        ),
        "velocity": F.when(velocity.isNotNull(), clip(velocity / 0.20, -1, 1)),
        "error": F.when(observed_f.isNotNull() & model_f.isNotNull(), clip((observed_f - model_f) / 4.0, -1, 1)),
        "cloud": F.when(cold_fraction.isNotNull(), -clip(cold_fraction / 0.50, 0, 1) * peak),
        "pressure": F.when(pressure_velocity.isNotNull(), -clip(pressure_velocity / 0.08, -1, 1)),
    }
    total = sum(DELTA_WEIGHTS.values())
    value, present = F.lit(0.0), F.lit(0)
    for name, part in parts.items():
        value = value + F.lit(DELTA_WEIGHTS[name] / total) * F.coalesce(part, F.lit(0.0))
        present = present + part.isNotNull().cast("int")
    value = clip(value, -1, 1)
    confidence = clip(present / 5.0 * F.exp(-F.greatest(F.lit(0.0), age_minutes) / 15.0), 0, 1)
    label = (
        F.when(value <= -0.35, "material_downside_to_model_high")
        .when(value >= 0.35, "material_upside_to_model_high")
        .when(value < -0.10, "mild_downside_to_model_high")
        .when(value > 0.10, "mild_upside_to_model_high")
        .otherwise("near_model_baseline")
    )
    return F.struct(
        value.alias("value"), confidence.alias("confidence"), peak.alias("peak"), label.alias("label"),
        *[F.coalesce(part, F.lit(0.0)).alias(name) for name, part in parts.items()],
    )


def convective_score(
    core_km: Column, core_bearing: Column, wind_from: Column, reflectivity: Column, flashes: Column, rain_mm_h: Column
) -> Column:
    """Struct (score, upwind): five capped terms that add up to at most one."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(0.30), (F.lit(20.0) - core_km) / 20.0 * 0.30))
    strong = F.greatest(F.lit(0.0), F.least(F.lit(0.25), (reflectivity - 30.0) / 30.0 * 0.25))
    electric = F.when(flashes > 0, F.least(F.lit(0.20), F.log1p(flashes.cast("double")) / F.log(F.lit(21.0)) * 0.20))
    wet = F.greatest(F.lit(0.0), F.least(F.lit(0.15), rain_mm_h / 25.0 * 0.15))
    upwind = F.coalesce(angular_difference_deg(core_bearing, wind_from) <= 45.0, F.lit(False))
    terms = [
        F.when(core_km.isNotNull(), near), F.when(reflectivity.isNotNull(), strong), electric,
        F.when(rain_mm_h.isNotNull(), wet), F.when(upwind, F.lit(0.10)),
    ]
    score = F.lit(0.0)
    for term in terms:
        score = score + F.coalesce(term, F.lit(0.0))
    return F.struct(F.least(F.lit(1.0), score).alias("score"), upwind.alias("upwind"))
