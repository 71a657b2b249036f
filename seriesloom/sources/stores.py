"""Tables kept between runs. What is written replaces earlier versions in one step per year or setup."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.publish import current, listed, marker, publish, set_marker

VERSION = "__version"


def write_years(df: DataFrame, path: str, time: str) -> None:
    """Write by year, replacing only the years that ``df`` holds. Runs a job.

    The files go to a folder of their own; then each year's marker is moved to it. A reader sees
    a year as it was or as it is now, and a write that does not finish changes nothing.
    """
    spark, version = df.sparkSession, f"{VERSION}={uuid.uuid4().hex}"
    rows = df.withColumn("year", F.year(time))
    # One exchange on year and day spreads a year over tasks and keeps its files few.
    rows = rows.repartition("year", F.dayofyear(time))
    rows.write.partitionBy("year").parquet(f"{path}/data/{version}")
    for name in listed(spark, f"{path}/data/{version}"):
        if name.startswith("year=") and name[5:].lstrip("-").isdigit():
            set_marker(spark, f"{path}/current/{name[5:]}", f"{version}/{name}")


def stored_years(spark: SparkSession, path: str) -> list[int]:
    """Years in the store, from a listing of their markers."""
    return sorted(int(n) for n in listed(spark, f"{path}/current") if n.lstrip("-").isdigit())


def read_years(spark: SparkSession, path: str, start: int, years: int) -> DataFrame:
    """Rows of ``years`` calendar years; other years' files are not opened."""
    have, last = stored_years(spark, path), start + years - 1
    if not have:
        raise ValueError(f"no years in {path}")
    wanted = [y for y in have if start <= y <= last] or have[:1]  # one for the schema
    folders = [f"{path}/data/{marker(spark, f'{path}/current/{y}')}" for y in wanted]
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders).drop(VERSION)
    return rows.where(F.col("year").between(start, last))


def missing_years(spark: SparkSession, path: str, start: int, years: int, current: int) -> list[int]:
    """Years of a range that have to be loaded: those absent, and always the current one.

    Lists the store's markers and reads no table.
    """
    have = set(stored_years(spark, path))
    return [y for y in range(start, start + years) if y not in have or y == current]


def _setup_key(setup: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(dict(setup), sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_metrics(metrics: DataFrame, path: str, setup: Mapping[str, object]) -> None:
    """Store metrics under their training setup, replacing those of the same setup only."""
    tagged = metrics.withColumns({k: F.lit(v) for k, v in setup.items()})
    publish(metrics.sparkSession, f"{path}/{_setup_key(setup)}", tagged.write.parquet)


def read_metrics(spark: SparkSession, path: str, setup: Mapping[str, object]) -> DataFrame:
    """Metrics of a setup, or of all setups that agree with the parts of one that are given."""
    own = current(spark, f"{path}/{_setup_key(setup)}")
    folders = [own] if own else [f for name in listed(spark, path) if (f := current(spark, f"{path}/{name}"))]
    if not folders:
        raise ValueError(f"no metrics in {path}")
    out = spark.read.parquet(*folders)
    for k, v in setup.items():
        out = out.where(F.col(k) == F.lit(v))
    return out
