"""Lags over the closed buckets of a stream.

``live.live_buckets`` emits each bucket once, when the watermark has passed it, so a later batch only
holds later buckets of a series. The sink here adds lags to every batch: it keeps the last rows of each
series, as many as the longest lag, puts them in front of the new ones and stores both results.

A batch is stored under its number, in folders of its own, and counts from the moment its marker is in
place. A batch that comes again, after a crash or a restart, is left as it is if its marker is there
and made anew if not, from the same tail; so any split into batches, with or without repeats, gives
the table of the batch query. A folder belongs to one query: its checkpoint lies inside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom._common import names
from seriesloom.operators.windows import ffill, lags, tail_rows
from seriesloom.session import fresh_path
from seriesloom.sources.publish import listed, marker, set_marker

Shifts = Mapping[str, tuple[str, int]]


def done_batches(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n) for n in listed(spark, f"{base}/done") if n.isdigit())


def _folders(spark: SparkSession, base: str, batch: int) -> dict[str, str]:
    return json.loads(marker(spark, f"{base}/done/{batch}"))


def add_batch(
    batch: DataFrame,
    number: int,
    base: str,
    shifts: Shifts,
    keys: str | Sequence[str],
    time: str,
    fill: Mapping[str, float] | None = None,
) -> None:
    """Store a batch of closed buckets with its lags. For ``foreachBatch``; runs three jobs.

    Lags count rows of a series. ``fill`` names columns whose missing values take the last one
    before them, and the value that stands before a series begins, in the lags too.
    """
    spark, keys, fill = batch.sparkSession, names(keys), dict(fill or {})
    earlier = [n for n in done_batches(spark, base) if n < number]
    if marker(spark, f"{base}/done/{number}") is not None:
        return
    both = batch.withColumn("_new", F.lit(True))
    if earlier:
        tail = spark.read.schema(batch.schema).parquet(_folders(spark, base, earlier[-1])["tail"])
        both = tail.withColumn("_new", F.lit(False)).unionByName(both)
    if fill:
        both = ffill(both, list(fill), keys, time)
    made = lags(both, shifts, keys, time)
    defaults = fill | {n: fill[c] for n, (c, _) in shifts.items() if c in fill}
    version = f"{number}-{uuid.uuid4().hex}"
    # Written once: the batch's own plan, which reads the stream's state, runs one time.
    made.write.parquet(f"{base}/made/{version}")
    made = spark.read.schema(made.schema).parquet(f"{base}/made/{version}")
    rows = made.where("_new").drop("_new").withColumns({c: F.coalesce(c, F.lit(float(v))) for c, v in defaults.items()})
    reach = max([k for _, k in shifts.values()], default=0)
    rows.write.parquet(f"{base}/rows/{version}")
    # at least one row, as its filled value goes on
    tail_rows(made.select(*batch.columns), max(1, reach), keys, time).write.parquet(f"{base}/tail/{version}")
    found = {"rows": f"{base}/rows/{version}", "tail": f"{base}/tail/{version}"}
    set_marker(spark, f"{base}/done/{number}", json.dumps(found))


def lagged_rows(spark: SparkSession, base: str, schema: StructType, shifts: Shifts) -> DataFrame:
    """The rows of all batches that are done."""
    folders = [_folders(spark, base, n)["rows"] for n in done_batches(spark, base)]
    whole = reduce(lambda s, n: s.add(n, schema[shifts[n][0]].dataType), shifts, StructType(list(schema.fields)))
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(*folders)


def run_lags(
    buckets: DataFrame,
    shifts: Shifts,
    keys: str | Sequence[str],
    time: str,
    fill: Mapping[str, float] | None = None,
    base: str | None = None,
) -> DataFrame:
    """Process the buckets that have closed, then return the table with their lags.

    ``base`` is the query's folder; running again with it goes on where the last run ended.
    Runs the stream to its end.
    """
    spark = buckets.sparkSession
    base = base or fresh_path(spark, "stream-lags")
    query = (
        buckets.writeStream.foreachBatch(lambda df, n: add_batch(df, n, base, shifts, keys, time, fill))
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return lagged_rows(spark, base, buckets.schema, shifts)
