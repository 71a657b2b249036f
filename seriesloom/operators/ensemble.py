"""Scenario and ensemble tables in long form: ``scenario, [draw,] step, value``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import col, names
from seriesloom.config import SEVERE_KP, STORM_KP
from seriesloom.functions.domain import weight_of

Weights = Mapping[str, float] | DataFrame
FAIL, LEAVE_OUT = "fail", "leave out"


def with_weights(
    df: DataFrame, weights: Weights, scenario: str = "scenario", unweighted: str = FAIL
) -> DataFrame:
    """Attach ``weight``; a scenario without one fails the job, as its rows would be lost.

    With ``unweighted="leave out"`` its rows go, and the other weights count as all there are.
    A mapping becomes a column expression. A table ``(scenario, weight)`` is joined, and Spark
    broadcasts it only if its measured size allows that.
    """
    if isinstance(weights, DataFrame):
        out = df.join(weights.select(F.col("scenario").alias(scenario), "weight"), scenario, "left")
    else:
        out = df.withColumn("weight", weight_of(scenario, weights))
    if unweighted == LEAVE_OUT:
        return out.where("weight is not null")
    if unweighted != FAIL:
        raise ValueError(f"unweighted is {unweighted!r}; use {FAIL!r} or {LEAVE_OUT!r}")
    message = F.concat(F.lit("no weight for scenario "), F.coalesce(F.col(scenario).cast("string"), F.lit("NULL")))
    known = F.when(F.col("weight").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("weight"))
    return out.withColumn("weight", known)


def scenario_summary(
    df: DataFrame, value: str, time: str, by: str | Sequence[str] = "scenario"
) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(v).alias("mean_value"),
        F.max(v).alias("peak_value"),
        F.count_if(v >= STORM_KP).alias("storm_rows"),
        F.count_if(v >= SEVERE_KP).alias("severe_rows"),
        F.min(F.when(v >= STORM_KP, F.col(time))).alias("first_storm"),
    )


def weighted_by_step(
    df: DataFrame,
    values: str | Sequence[str],
    weights: Weights,
    step: str | Sequence[str] = "step",
    scenario: str = "scenario",
    unweighted: str = FAIL,
) -> DataFrame:
    """Weighted mean over scenarios per step, with the weights scaled to sum to 1."""
    weighted = with_weights(df, weights, scenario, unweighted)
    return weighted.groupBy(*names(step)).agg(
        *[
            (F.sum(F.col(v) * F.col("weight")) / F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))).alias(v)
            for v in names(values)
        ]
    )


def envelope(df: DataFrame, value: str, step: str | Sequence[str] = "step") -> DataFrame:
    return df.groupBy(*names(step)).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def exceedance_by_step(
    draws: DataFrame,
    value: str,
    weights: Weights,
    threshold: float = STORM_KP,
    keys: str | Sequence[str] = (),
    unweighted: str = FAIL,
) -> DataFrame:
    """Probability per step that a draw reaches the threshold, weighted over scenarios."""
    keys = names(keys)
    share = draws.groupBy(*keys, "scenario", "step").agg(_share(value, threshold).alias("probability"))
    return weighted_by_step(share, "probability", weights, [*keys, "step"], unweighted=unweighted)


def exceedance_any_step(
    draws: DataFrame,
    value: str,
    weights: Weights,
    threshold: float = STORM_KP,
    keys: str | Sequence[str] = (),
    unweighted: str = FAIL,
) -> DataFrame:
    """Probability that a draw reaches the threshold at least once: per draw first, then over
    draws, then over scenarios."""
    keys = names(keys)
    peaks = draws.groupBy(*keys, "scenario", "draw").agg(F.max(value).alias("_peak"))
    share = peaks.groupBy(*keys, "scenario").agg(
        _share("_peak", threshold).alias("probability"), F.count(F.lit(1)).alias("draws")
    )
    weighted = with_weights(share, weights, unweighted=unweighted)
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("probability") * F.col("weight")) / F.sum("weight")).alias("probability"),
        F.min("draws").alias("draws"),
    )


def _share(value: str | Column, threshold: float) -> Column:
    return F.avg((col(value) >= threshold).cast("double"))
