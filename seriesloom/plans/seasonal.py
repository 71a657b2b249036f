"""The monthly index: features, training table, recursive forecast, cycle phase, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names, over, series_keys
from seriesloom.config import MONTHLY_LAGS, SEASONAL_FEATURES, SeasonalConfig, StormConfig
from seriesloom.functions.domain import (
    activity_tier,
    adjusted_weights,
    cycle_position,
    flux_proxy,
    fourier_terms,
    storm_rate_modifier,
)
from seriesloom.functions.timeaxis import mid_month_axis, month_index
from seriesloom.operators import model as m
from seriesloom.operators.recursive import recursive_score, seed_array, step_arrays
from seriesloom.operators.splits import time_split
from seriesloom.operators.verify import mae, r2, with_train_mean
from seriesloom.operators.windows import last_row, rolling
from seriesloom.session import written

TARGET = "ssn_next"
SEED_MONTHS = 36


def seasonal_features(
    monthly: DataFrame,
    keys: str | Sequence[str],
    time: str = "time_tag",
    value: str = "ssn",
    period: int = 132,
) -> DataFrame:
    """Lags, trailing means and Fourier terms, plus the next month's value as target.

    A series has one row per month, so one ordinary window per series serves them all.
    """
    keys = names(keys)
    w = over(keys, time)

    def trailing(rows: int, least: int) -> Column:
        frame = w.rowsBetween(-(rows - 1), 0)
        return F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))

    added = {f"ssn_lag_{k}m": F.lag(value, k).over(w) for k in MONTHLY_LAGS}
    added |= {"ssn_roll3m": trailing(3, 1), "ssn_roll12m": trailing(12, 6)}
    added |= {TARGET: F.lead(value, 1).over(w)}
    frame = monthly.withColumns(added).withColumns(fourier_terms(month_index(time), period))
    ready = frame.na.drop("any", subset=[value, *SEASONAL_FEATURES])
    return ready.select(*keys, time, value, *SEASONAL_FEATURES, TARGET)


def train_seasonal(
    monthly: DataFrame, keys: str | Sequence[str], config: SeasonalConfig, time: str = "time_tag"
) -> tuple[PipelineModel, DataFrame]:
    """Fit one step ahead on the first part of every series, return test rows with ``ssn_pred``
    and the training mean as ``baseline``. Runs jobs."""
    keys = names(keys)
    rows = seasonal_features(monthly, keys, time, period=config.period_months)
    rows = rows.where(F.col(TARGET).isNotNull())
    # Written once: scaler, trees, baseline and predictions all read it.
    split = written(time_split(rows, config.train_fraction, keys, time, 12, 12, span="3650 days"), "months-split")
    model = m.fit(split.where("is_train"), SEASONAL_FEATURES, TARGET, config.trees)
    test = with_train_mean(split, TARGET, "baseline", keys)
    return model, m.predict(model, test, "ssn_pred", low=0.0)


def seasonal_scores(test: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    return test.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias("test_months"),
        mae(TARGET, "ssn_pred").alias("mae"),
        r2(TARGET, "ssn_pred").alias("r2"),
        mae(TARGET, "baseline").alias("baseline_mae"),
    )


def scoring_features(past: Column, step: Column) -> dict[str, Column]:
    """Lags counted from the target month, and the phase of the target month.

    This is one month closer than in training, where lag 1 lies two months before the target.
    Results have to agree with that, so it stays the default; pass another mapping to change it.
    """
    made = {f"ssn_lag_{k}m": F.element_at(past, -k) for k in MONTHLY_LAGS}
    made |= {f"ssn_roll{n}m": _tail_mean(past, n) for n in (3, 12)}
    return made | {c: step[c] for c in ("sin_11yr", "cos_11yr", "sin_5p5yr", "cos_5p5yr")}


def _tail_mean(values: Column, n: int) -> Column:
    total = F.aggregate(F.slice(values, -n, n), F.lit(0.0), lambda acc, v: acc + v)
    return total / F.lit(float(n))


def forecast_months(
    model: PipelineModel,
    monthly: DataFrame,
    keys: str | Sequence[str],
    config: SeasonalConfig,
    time: str = "time_tag",
    features=scoring_features,
) -> DataFrame:
    """``keys, step, time, ssn, status``: the coming months of every series.

    A series with fewer than 36 months has no complete lags: its ``ssn`` is NULL and its
    ``status`` ``too few months``.
    """
    keys = series_keys(keys)
    last = monthly.where(F.col("ssn").isNotNull()).groupBy(*keys).agg(F.max(time).alias("_last"))
    steps = last.select(*keys, F.posexplode(mid_month_axis(F.col("_last"), config.months_ahead)))
    steps = steps.select(*keys, F.col("pos").alias("step"), F.col("col").alias(time))
    steps = steps.withColumns(fourier_terms(month_index(time), config.period_months))
    phase = ["sin_11yr", "cos_11yr", "sin_5p5yr", "cos_5p5yr"]
    inputs = step_arrays(steps, keys, "step", [time, *phase])
    seeds = seed_array(monthly, keys, time, "ssn", SEED_MONTHS)
    both = inputs.join(seeds, keys)
    enough = F.size("seed") >= SEED_MONTHS
    scored = recursive_score(
        model, both.where(enough), keys, config.months_ahead, features, "ssn", low=0.0, carry=[time]
    )
    short = both.where(~enough).select(*keys, F.posexplode("inputs").alias("step", "_in"))
    short = short.select(*keys, "step", F.col("_in")[time].alias(time), F.lit(None).cast("double").alias("ssn"))
    return scored.withColumn("status", F.lit("ok")).unionByName(short.withColumn("status", F.lit("too few months")))


def cycle_phase(
    monthly: DataFrame,
    forecast: DataFrame,
    keys: str | Sequence[str],
    config: SeasonalConfig,
    time: str = "time_tag",
    months_ahead: int = 6,
    at_last_observed: bool = False,
) -> DataFrame:
    """Smoothed level, position in the cycle and what follows from them, per series.

    The centred 13-month mean is taken over observed months and the first ``months_ahead``
    forecast ones. The level is that of the last of these rows, so it describes a time ahead
    of the observations; ``at_last_observed`` takes the last observed month instead.
    """
    keys = series_keys(keys)
    seen = monthly.select(*keys, time, "ssn", F.lit(True).alias("_observed"))
    ahead = forecast.where((F.col("step") < months_ahead) & F.col("ssn").isNotNull())
    ahead = ahead.select(*keys, time, "ssn", F.lit(False).alias("_observed"))
    joined = seen.unionByName(ahead)
    smooth = rolling(joined, "ssn", 13, "level", keys, time, 7, centred=True)
    smooth = smooth.where("level is not null")
    in_cycle = F.col(time) >= F.lit(config.cycle_start).cast("timestamp_ntz")
    current = smooth.where("_observed") if at_last_observed else smooth
    current = last_row(current.select(*keys, time, "level"), keys, time)
    extremes = smooth.groupBy(*keys).agg(
        F.min(F.when(in_cycle, F.col("level"))).alias("_lo"),
        F.max(F.when(in_cycle, F.col("level"))).alias("_hi"),
    )
    out = current.join(extremes, keys)
    out = out.withColumns(
        {
            "_lo": F.coalesce("_lo", F.lit(0.0)),
            "_hi": F.coalesce("_hi", F.greatest("level", F.lit(1.0))),
        }
    )
    out = out.withColumn("position", cycle_position("level", "_lo", "_hi"))
    return out.select(
        *keys,
        F.bround("level", 1).alias("current_smooth_ssn"),
        F.bround(flux_proxy("level"), 1).alias("f107_proxy"),
        F.bround("position", 3).alias("ssn_normalized"),
        activity_tier("level").alias("solar_activity_tier"),
        F.bround(storm_rate_modifier("position"), 3).alias("storm_rate_modifier"),
        F.bround("_lo", 1).alias("cycle_min_ssn"),
        F.bround("_hi", 1).alias("cycle_max_observed_ssn"),
    )


def recommended_weights(
    phase: DataFrame, keys: str | Sequence[str], storm: StormConfig | None = None
) -> DataFrame:
    """Scenario weights of each series as rows ``keys, scenario, weight``."""
    keys = names(keys)
    weights = adjusted_weights("storm_rate_modifier", (storm or StormConfig()).weights)
    pairs = [F.struct(F.lit(k).alias("scenario"), w.alias("weight")) for k, w in weights.items()]
    return phase.select(*keys, F.explode(F.array(*pairs)).alias("_w")).select(*keys, "_w.*")


def from_year(monthly: DataFrame, year: int, time: str = "time_tag") -> DataFrame:
    return monthly.where(F.col(time) >= F.make_timestamp_ntz(*[F.lit(x) for x in (year, 1, 1, 0, 0, 0)]))
