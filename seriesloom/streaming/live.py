"""Streaming forms of the bucket aggregation and of the removal of re-delivered rows.

Watermarks need ``timestamp`` columns; UTC ``timestamp_ntz`` input is cast on the way in.
Lags over closed buckets are in ``lagged``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom._common import names
from seriesloom.session import fresh_path

LATENESS = "6 hours"


def read_snapshots(
    spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def without_repeats(
    stream: DataFrame, columns: Sequence[str], time: str, lateness: str = LATENESS
) -> DataFrame:
    """Drop rows delivered again within the watermark; state is bounded by the lateness."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(columns))


def live_buckets(
    stream: DataFrame,
    time: str,
    every: str,
    aggs: Sequence[Column],
    keys: str | Sequence[str] = (),
    lateness: str = LATENESS,
) -> DataFrame:
    """Tumbling buckets, each emitted once when the watermark has passed its end."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return _buckets(timed, time, every, aggs, keys)


def live_buckets_deduped(
    stream: DataFrame,
    columns: Sequence[str],
    time: str,
    every: str,
    aggs: Sequence[Column],
    keys: str | Sequence[str] = (),
    lateness: str = LATENESS,
) -> DataFrame:
    """Both steps in one query, under one watermark."""
    return _buckets(without_repeats(stream, columns, time, lateness), time, every, aggs, keys)


def _buckets(timed: DataFrame, time: str, every: str, aggs, keys) -> DataFrame:
    keys = names(keys)
    out = timed.groupBy(*keys, F.window(time, every).alias("_w")).agg(*aggs)
    rest = [c for c in out.columns if c not in (*keys, "_w")]
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias(time), *rest)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what has arrived, then return the sink as a table.

    Checkpoint and sink lie below the shared folder, so a lost executor or a restarted query
    continues where it was. Runs the stream to its end.
    """
    spark = stream.sparkSession
    base = fresh_path(spark, f"stream-{label}")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .option("path", f"{base}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
