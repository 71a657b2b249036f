"""Training, scoring and summarising of the 3-hour storm forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import interval, names
from seriesloom.config import QUIET_KP, RECURRENCE, STORM_FEATURES, STORM_KP, StormConfig
from seriesloom.functions.clean import finite_or_zero
from seriesloom.functions.domain import coupling, equinox_term, ram_pressure, southward_field
from seriesloom.operators import ensemble, verify
from seriesloom.operators import model as m
from seriesloom.operators.asof import asof_forward
from seriesloom.operators.recursive import attach_seed, recursive_score, seed_array, step_arrays
from seriesloom.operators.splits import time_split
from seriesloom.operators.windows import rolling
from seriesloom.session import written

LAGS = {"kp_lag_3h": 1, "kp_lag_6h": 2, "kp_lag_9h": 3}
STEP_INPUTS = [f for f in STORM_FEATURES if f not in LAGS]


def train_storm(
    frame: DataFrame, keys: str | Sequence[str], config: StormConfig, time: str = "time_tag"
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the early part of every series; test rows with ``Kp_pred`` and ``baseline``.
    Runs jobs."""
    keys = names(keys)
    # Written once: scaler, trees, baseline and predictions all read it.
    split = written(time_split(frame, config.train_fraction, keys, time), "split")
    model = m.fit(split.where("is_train"), STORM_FEATURES, "Kp", config.trees)
    test = verify.with_train_mean(split, "Kp", "baseline", keys)
    return model, m.predict(model, test, "Kp_pred")


def storm_scores(test: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """All scores of the report in one aggregation, with skill against the references."""
    scores = test.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias("test_count"),
        verify.mae("Kp", "Kp_pred").alias("mae"),
        verify.r2("Kp", "Kp_pred").alias("r2"),
        verify.mae("Kp", "baseline").alias("baseline_mae"),
        verify.mae("Kp", "kp_lag_3h").alias("persistence_mae"),
        verify.r2("Kp", "kp_lag_3h").alias("persistence_r2"),
    )
    return verify.skill(scores)


def step_inputs(
    scenarios: DataFrame,
    history: DataFrame | None,
    keys: str | Sequence[str],
    trajectory: str | Sequence[str] = "scenario",
    time: str = "time_tag",
) -> DataFrame:
    """Inputs of each step that do not depend on predictions.

    ``scenarios`` is long: ``keys, trajectory, step, time, speed, density, by_gsm, bz_gsm, bt``.
    ``bz_min`` is a trailing minimum over 3 steps here, not the minimum inside a bucket as in
    training; results have to agree with that. The 27-day value is looked up once per series
    and time, then joined to all trajectories.
    """
    keys, trajectory = names(keys), names(trajectory)
    if history is None:
        out = scenarios.withColumn("kp_lag_27d", F.lit(QUIET_KP))
    else:
        past = recurrence_by_time(scenarios, history, keys, time)
        out = scenarios.join(past, [*keys, time], "left")
        out = out.withColumn("kp_lag_27d", F.coalesce("kp_lag_27d", F.lit(QUIET_KP)))
    # Last, because the arrays that follow need the same partitioning.
    out = rolling(out, "bz_gsm", 3, "bz_min", [*keys, *trajectory], "step", agg=F.min)
    made = {
        "speed_mean": F.col("speed"),
        "density_mean": F.col("density"),
        "by_mean": F.col("by_gsm"),
        "bz_mean": F.col("bz_gsm"),
        "bz_min": F.col("bz_min"),
        "bt_mean": F.col("bt"),
        "coupling_mean": coupling("speed", "bt", "by_gsm", "bz_gsm"),
        "p_dyn_mean": ram_pressure("density", "speed"),
        "kp_lag_27d": F.col("kp_lag_27d"),
        "vbs": southward_field("speed", "bz_gsm"),
        "equinox_term": equinox_term(time),
    }
    cleaned = [finite_or_zero(c).alias(n) for n, c in made.items()]
    return out.select(*keys, *trajectory, "step", time, *cleaned)


def recurrence_by_time(
    times: DataFrame, history: DataFrame, keys: str | Sequence[str], time: str = "time_tag"
) -> DataFrame:
    """``Kp`` 27 days before each distinct time of a series; NULL where there is none near."""
    keys = names(keys)
    probes = times.select(*keys, time).distinct().withColumn("_earlier", F.col(time) - interval(RECURRENCE))
    past = history.select(*keys, F.col(time).alias("_at"), "Kp")
    found = asof_forward(probes, past, "_earlier", "_at", "Kp", "kp_lag_27d", keys)
    return found.select(*keys, time, "kp_lag_27d")


def storm_features(past: Column, step: Column) -> dict[str, Column]:
    made = {n: F.element_at(past, -k) for n, k in LAGS.items()}
    return made | {c: step[c] for c in STEP_INPUTS}


def forecast_storms(
    model: PipelineModel,
    scenarios: DataFrame,
    observed_kp: DataFrame,
    history: DataFrame | None,
    keys: str | Sequence[str],
    steps: int,
    trajectory: str | Sequence[str] = "scenario",
    time: str = "time_tag",
) -> DataFrame:
    """``keys, trajectory, step, time, kp`` by feeding each prediction back as a lag."""
    keys, trajectory = names(keys), names(trajectory)
    inputs = step_inputs(scenarios, history, keys, trajectory, time)
    arrays = step_arrays(inputs, [*keys, *trajectory], "step", [time, *STEP_INPUTS])
    seeds = seed_array(observed_kp, keys, time, "Kp", 3)
    ready = attach_seed(arrays, seeds, keys, 3, QUIET_KP)
    return recursive_score(
        model,
        ready,
        [*keys, *trajectory],
        steps,
        storm_features,
        "kp",
        low=0.0,
        high=9.0,
        carry=[time],
    )


def storm_outlook(
    draws: DataFrame, weights: ensemble.Weights, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Any-step storm probability with its standard error and a mark for very low values."""
    out = ensemble.exceedance_any_step(draws, "kp", weights, STORM_KP, keys)
    return out.withColumns(
        {
            "standard_error": verify.probability_error("probability", F.col("draws")),
            "low_probability": verify.is_low_probability("probability"),
        }
    )
