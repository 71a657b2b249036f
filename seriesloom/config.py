"""Settings of the two forecasting flows.

The values are fixed: they have to equal the published ones for results to agree.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Ordered input contract of the 3-hour storm model.
STORM_FEATURES = (
    "speed_mean",
    "density_mean",
    "by_mean",
    "bz_mean",
    "bz_min",
    "bt_mean",
    "coupling_mean",
    "p_dyn_mean",
    "kp_lag_3h",
    "kp_lag_6h",
    "kp_lag_9h",
    "kp_lag_27d",
    "vbs",
    "equinox_term",
)

# Ordered input contract of the monthly model.
SEASONAL_FEATURES = (
    "ssn_lag_1m",
    "ssn_lag_2m",
    "ssn_lag_3m",
    "ssn_lag_6m",
    "ssn_lag_12m",
    "ssn_lag_24m",
    "ssn_lag_36m",
    "ssn_roll3m",
    "ssn_roll12m",
    "sin_11yr",
    "cos_11yr",
    "sin_5p5yr",
    "cos_5p5yr",
)

# Fill codes that stand for "missing" in the hourly archive, by column.
ARCHIVE_SENTINELS = {
    "speed": (9999.0, 99999.9),
    "density": (999.9,),
    "bt": (999.9,),
    "by_gsm": (999.9,),
    "bz_gsm": (999.9,),
    "kp_raw": (99.0,),
}

QUIET_KP = 2.0
STORM_KP = 5.0
SEVERE_KP = 7.0
RECURRENCE = "27 days"
MONTHLY_LAGS = (1, 2, 3, 6, 12, 24, 36)
STORM_LAGS = {"kp_lag_3h": 1, "kp_lag_6h": 2, "kp_lag_9h": 3, "kp_lag_27d": 216}


@dataclass(frozen=True)
class TreeSettings:
    """Boosted-tree settings; the defaults are those of the storm model."""

    trees: int = 200
    depth: int = 3
    rate: float = 0.05
    row_share: float = 0.8
    min_leaf: int = 5
    seed: int = 42


@dataclass(frozen=True)
class StormConfig:
    start_year: int = 2020
    years: int = 5
    train_fraction: float = 0.75
    trees: TreeSettings = field(default_factory=TreeSettings)
    steps: int = 24
    weights: Mapping[str, float] = field(
        default_factory=lambda: {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.3}
    )
    folds: int = 5
    fold_gap: int = 3
    fold_trees: int = 100


@dataclass(frozen=True)
class SeasonalConfig:
    start_year: int = 1950
    months_ahead: int = 12
    train_fraction: float = 0.85
    trees: TreeSettings = field(default_factory=lambda: TreeSettings(trees=300, rate=0.03))
    period_months: int = 132
    cycle_start: str = "2019-01-01"
