"""Nested result documents and their JSON sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import series_keys
from seriesloom.functions.timeaxis import iso_time


def ordered_array(step: str, value: Column) -> Column:
    """Aggregate the steps of one forecast into an array in step order; missing values stay NULL."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def forecast_arrays(
    by_scenario: DataFrame,
    by_step: DataFrame,
    keys: str | Sequence[str],
    value: str,
    step: str = "step",
) -> DataFrame:
    """One ``forecast`` struct per series: times, a map of arrays by scenario, and arrays of the
    per-step columns. Arrays are as long as the forecast horizon."""
    keys = series_keys(keys)
    per_scenario = by_scenario.groupBy(*keys, "scenario").agg(
        ordered_array(step, F.col(value)).alias("_values")
    )
    maps = per_scenario.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", "_values")))).alias(
            "_by_scenario"
        )
    )
    columns = [c for c in by_step.columns if c not in (*keys, step, "time_tag")]
    arrays = by_step.groupBy(*keys).agg(
        ordered_array(step, iso_time("time_tag")).alias("_times"),
        *[ordered_array(step, F.col(c)).alias(c) for c in columns],
    )
    both = arrays.join(maps, keys)
    forecast = F.struct(
        F.col("_times").alias("times"), F.col("_by_scenario").alias("by_scenario"), *columns
    )
    return both.select(*keys, forecast.alias("forecast"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row; NULL fields are written as null. Runs a job."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
