"""Column expressions of the space-weather and seasonal feature frames."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom._common import col
from seriesloom.functions.clean import clip, nan_to_null

__all__ = [
    "activity_tier",
    "adjusted_weights",
    "blend_with_observed",
    "coupling",
    "coupling_without_angle",
    "cycle_position",
    "equinox_term",
    "flux_proxy",
    "fourier_terms",
    "kp_label",
    "ram_pressure",
    "southward_field",
    "storm_rate_modifier",
    "weight_of",
]

# Upper bounds (exclusive) and names of the activity classes.
KP_CLASSES = (
    (4.0, "Quiet"),
    (5.0, "Unsettled / Active"),
    (6.0, "G1 - Minor storm"),
    (7.0, "G2 - Moderate storm"),
    (8.0, "G3 - Strong storm"),
    (9.0, "G4 - Severe storm"),
    (math.inf, "G5 - Extreme storm"),
)
ACTIVITY_TIERS = (
    (30.0, "Minimum"),
    (80.0, "Rising / Declining"),
    (140.0, "Moderate Maximum"),
    (math.inf, "High Maximum"),
)


def _class_of(value: Column, classes) -> Column:
    out = None
    for upper, label in classes:
        inside = value < F.lit(upper) if upper < math.inf else value.isNotNull()
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def kp_label(kp: str | Column) -> Column:
    return _class_of(col(kp), KP_CLASSES)


def activity_tier(level: str | Column) -> Column:
    return _class_of(col(level), ACTIVITY_TIERS)


def coupling_without_angle(speed: str | Column, bt: str | Column) -> Column:
    return nan_to_null(F.pow(col(speed), F.lit(4.0 / 3.0)) * F.pow(col(bt), F.lit(2.0 / 3.0)))


def coupling(speed: str | Column, bt: str | Column, by: str | Column, bz: str | Column) -> Column:
    """Newell et al. (2007) coupling; NULL where the field magnitude is negative."""
    half_angle = F.atan2(F.abs(col(by)), col(bz)) / 2.0
    return nan_to_null(
        coupling_without_angle(speed, bt) * F.pow(F.sin(half_angle), F.lit(8.0 / 3.0))
    )


def ram_pressure(density: str | Column, speed: str | Column) -> Column:
    return col(density) * F.pow(col(speed) / 100.0, F.lit(2.0))


def southward_field(speed: str | Column, bz: str | Column) -> Column:
    """Rectified southward electric field."""
    southward = F.when(col(bz).isNotNull(), F.greatest(F.lit(0.0), -col(bz)))
    return col(speed) * southward / 1000.0


def equinox_term(time: str | Column) -> Column:
    day = F.dayofyear(col(time)).cast("double")
    return F.cos(F.lit(4.0 * math.pi) * (day - 80.0) / 365.25)


def fourier_terms(month: Column, period: int) -> dict[str, Column]:
    """First and second harmonic of a month index; named for the 132-month period."""
    base, second = (F.lit(k * math.pi) * month / float(period) for k in (2.0, 4.0))
    return {
        "sin_11yr": F.sin(base),
        "cos_11yr": F.cos(base),
        "sin_5p5yr": F.sin(second),
        "cos_5p5yr": F.cos(second),
    }


def flux_proxy(level: str | Column) -> Column:
    return F.lit(67.0) + F.lit(0.32) * col(level)


def cycle_position(level: str | Column, low: str | Column, high: str | Column) -> Column:
    """Where the level lies between the cycle's extremes, 0 to 1; the range counts as at least 1."""
    width = F.greatest(col(high) - col(low), F.lit(1.0))
    return clip((col(level) - col(low)) / width, 0.0, 1.0)


def storm_rate_modifier(position: str | Column) -> Column:
    return clip(F.lit(0.4) + F.lit(1.2) * col(position), 0.2, 2.0)


def adjusted_weights(modifier: str | Column, base: Mapping[str, float]) -> dict[str, Column]:
    """Scale the ``Active`` weight, keep the ratio of the others, normalise, round half to even."""
    active = F.lit(float(base["Active"])) * col(modifier)
    others = {k: v for k, v in base.items() if k != "Active"}
    rest = F.lit(1.0) - active
    raw = {k: rest * F.lit(v / sum(others.values())) for k, v in others.items()}
    raw["Active"] = active
    total = sum(list(raw.values())[1:], list(raw.values())[0])
    return {k: F.bround(v / total, 3) for k, v in raw.items()}


def weight_of(scenario: str | Column, weights: Mapping[str, float]) -> Column:
    """Weight of a scenario from a driver-side mapping, NULL for a scenario without one."""
    out = None
    for name, weight in weights.items():
        hit = col(scenario) == F.lit(name)
        out = F.when(hit, F.lit(float(weight))) if out is None else out.when(hit, F.lit(float(weight)))
    return out


def blend_with_observed(step: Column, value: Column, observed: Column) -> Column:
    """Pull the first two steps of a trajectory towards the last observation."""
    return (
        F.when(step == 0, F.lit(0.8) * observed + F.lit(0.2) * value)
        .when(step == 1, F.lit(0.4) * observed + F.lit(0.6) * value)
        .otherwise(value)
    )
