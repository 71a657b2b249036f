"""Fixed time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import floor_div, from_micros, interval, micros, names, require_utc, span_us


def resample(
    df: DataFrame,
    time: str,
    every: str,
    aggs: Sequence[Column],
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """Aggregate into left-closed buckets that carry their left edge as ``time``.

    Buckets without rows do not appear. All work before the shuffle is a partial
    aggregation, so the shuffle carries one row per task, key and bucket.
    """
    keys = names(keys)
    grouped = df.groupBy(*keys, F.window(time, every).alias("_bucket")).agg(*aggs)
    rest = [c for c in grouped.columns if c not in keys and c != "_bucket"]
    return grouped.select(
        *keys, F.col("_bucket.start").cast("timestamp_ntz").alias(time), *rest
    )


def grid(df: DataFrame, time: str, every: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """Every bucket edge between the first and the last row of each series.

    The axis is laid out in two steps, slices and then the edges in each slice, so that no
    row holds a long array however fine the step.
    """
    require_utc(df)
    keys = names(keys)
    width = span_us(every)
    per_slice = 1024
    ends = df.groupBy(*keys).agg(
        F.min(floor_div(micros(time), width)).alias("_lo"),
        F.max(floor_div(micros(time), width)).alias("_hi"),
    )
    slices = ends.where("_lo is not null").select(
        *keys, "_hi", F.explode(F.sequence("_lo", "_hi", F.lit(per_slice))).alias("_from")
    )
    last = F.least(F.col("_hi"), F.col("_from") + (per_slice - 1))
    edges = slices.select(*keys, F.explode(F.sequence(F.col("_from"), last)).alias("_i"))
    return edges.select(*keys, from_micros(F.col("_i") * F.lit(width)).alias(time))


def resample_full(
    df: DataFrame,
    time: str,
    every: str,
    aggs: Sequence[Column],
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """As :func:`resample`, with a row of NULLs for each empty bucket inside a series' range."""
    keys = names(keys)
    filled = resample(df, time, every, aggs, keys)
    return grid(filled, time, every, keys).join(filled, [*keys, time], "left")


def lookback_join(
    df: DataFrame,
    history: DataFrame,
    time: str,
    back: str,
    value: str,
    name: str,
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """The value exactly ``back`` earlier, by an equi-join on the shifted time."""
    keys = names(keys)
    shifted = history.select(
        *keys, (F.col(time) + interval(back)).alias(time), F.col(value).alias(name)
    )
    return df.join(shifted, [*keys, time], "left")
