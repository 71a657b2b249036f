"""Multi-step scoring in which each prediction is an input of the next step.

A trajectory is one row: a short array of seed values and an array with the known inputs of
every step. Steps follow each other inside the row, trajectories are spread over the cluster,
and no step shuffles. The model is applied with its own ``transform``, so scoring stays in
the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names, series_keys
from seriesloom.functions.clean import clip
from seriesloom.operators.model import PREDICTION
from seriesloom.operators.windows import tail_rows
from seriesloom.session import written

Features = Callable[[Column, Column], Mapping[str, Column]]
CUT_EVERY = 24


def seed_array(
    history: DataFrame,
    keys: str | Sequence[str],
    time: str,
    value: str,
    rows: int,
    name: str = "seed",
) -> DataFrame:
    """The last ``rows`` values of each series, oldest first, as an array."""
    keys = names(keys)
    known = history.where(F.col(value).isNotNull()).select(*keys, time, value)
    last = tail_rows(known, rows, keys, time)
    pairs = F.array_sort(F.collect_list(F.struct(time, value)))
    return last.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def left_pad(values: str, rows: int, default: float) -> Column:
    """Array of at least ``rows`` values, with defaults put before the given ones."""
    given = F.coalesce(F.col(values), F.array().cast("array<double>"))
    missing = F.greatest(F.lit(rows) - F.size(given), F.lit(0))
    return F.concat(F.array_repeat(F.lit(float(default)), missing), given)


def step_arrays(
    steps: DataFrame, keys: str | Sequence[str], step: str, columns: Sequence[str], name: str = "inputs"
) -> DataFrame:
    """One row per trajectory with its step inputs in order; as long as the forecast horizon."""
    collected = F.array_sort(F.collect_list(F.struct(step, *columns)))
    return steps.groupBy(*names(keys)).agg(collected.alias(name))


def recursive_score(
    model: PipelineModel,
    trajectories: DataFrame,
    keys: str | Sequence[str],
    steps: int,
    features: Features,
    name: str,
    seed: str = "seed",
    inputs: str = "inputs",
    low: float | None = None,
    high: float | None = None,
    carry: Sequence[str] = (),
    cut_every: int = CUT_EVERY,
) -> DataFrame:
    """Long table ``keys, step, carry, name`` of ``steps`` predictions per trajectory.

    ``features`` maps the values so far (an array, newest last) and the inputs of a step (a
    struct) to the model's features, which decides how predictions become lags. ``carry``
    names inputs to return with the predictions.

    The plan holds one application of the model per step, so after every ``cut_every`` steps the
    trajectories are written and read again, which runs a job. Any horizon then plans in the same
    time per step; up to ``cut_every`` steps nothing is written.
    """
    keys = names(keys)
    carried = trajectories.select(*keys, F.col(inputs).alias("_in"), F.col(seed).alias("_past"))
    for i in range(steps):
        made = features(F.col("_past"), F.col("_in")[i])
        scored = model.transform(carried.withColumns(dict(made)))
        value = clip(PREDICTION, low, high)
        carried = scored.select(*keys, "_in", F.concat("_past", F.array(value)).alias("_past"))
        if (i + 1) % cut_every == 0 and i + 1 < steps:
            carried = written(carried, "trajectories")
    new = F.slice("_past", F.size("_past") - (steps - 1), steps)
    rows = carried.select(*keys, "_in", F.posexplode(new).alias("step", name))
    given = [F.col("_in")[F.col("step")][c].alias(c) for c in carry]
    return rows.select(*keys, "step", *given, name)


def attach_seed(
    trajectories: DataFrame,
    seeds: DataFrame,
    keys: str | Sequence[str],
    rows: int,
    default: float,
    seed: str = "seed",
) -> DataFrame:
    """Join the seed of each series to its trajectories and pad short or missing ones."""
    joined = trajectories.join(seeds, series_keys(keys), "left")
    return joined.withColumn(seed, left_pad(seed, rows, default))
