"""Streaming queries over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.session import fresh_path
from seriesloom.streaming import lagged, live
from workload.registry import R, query, r
from workload.series import table


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return live.read_snapshots(spark, sf_dir, schema, "events.parquet")


CLOSED = "time_bucket(INTERVAL 3 HOUR, ts) + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)"


@query(
    "live_buckets",
    f"""SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts) AS ts, {R('avg(value)')} AS v_mean, min(value) AS v_min, count(*) AS n
    FROM events WHERE {CLOSED} GROUP BY 1, 2""",
)
def live_buckets(spark, sf_dir):
    aggs = [F.avg("value").alias("v_mean"), F.min("value").alias("v_min"), F.count(F.lit(1)).alias("n")]
    out = live.live_buckets(_stream(spark, sf_dir), "ts", "3 hours", aggs, "event_type")
    return live.run_available(out, "buckets").withColumn("v_mean", r("v_mean"))


@query("live_dedupe", "SELECT DISTINCT event_id, ts, value FROM events")
def live_dedupe(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("event_id", "ts", "value")
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = live.without_repeats(twice, ["event_id", "ts", "value"], "ts")
    return live.run_available(out, "dedupe").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "live_buckets_deduped",
    f"""SELECT time_bucket(INTERVAL 3 HOUR, ts) AS ts, {R('avg(value)')} AS v_mean, count(*) AS n FROM events WHERE {CLOSED} GROUP BY 1""",
)
def live_buckets_deduped(spark, sf_dir):
    stream = _stream(spark, sf_dir).select("event_id", "ts", "value")
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    aggs = [F.avg("value").alias("v_mean"), F.count(F.lit(1)).alias("n")]
    out = live.live_buckets_deduped(twice, ["event_id", "ts"], "ts", "3 hours", aggs)
    return live.run_available(out, "buckets-deduped").withColumn("v_mean", r("v_mean"))


@query(
    "live_lags",
    f"""SELECT event_type, ts, v, coalesce(lag(v, 1) OVER w, 2.0) AS lag_1, coalesce(lag(v, 3) OVER w, 2.0) AS lag_3, coalesce(lag(n, 2) OVER w, 0) AS n_2 FROM (
      SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts) AS ts, max(value) AS v, count(*) AS n FROM events WHERE {CLOSED} GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def live_lags(spark, sf_dir):
    """Lags of closed buckets, over the events landed in four deliveries."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("z")).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - ends.a) * 4 / (ends.z - ends.a + 1))
    path = fresh_path(spark, "deliveries")
    for i in range(4):
        events.where(part == i).coalesce(1).write.parquet(f"{path}/{i}")
    stream = live.read_snapshots(spark, f"{path}/*", events.schema, files_per_batch=1)
    aggs = [F.max("value").alias("v"), F.count(F.lit(1)).alias("n")]
    buckets = live.live_buckets(stream, "ts", "3 hours", aggs, "event_type")
    return lagged.run_lags(buckets, {"lag_1": ("v", 1), "lag_3": ("v", 3), "n_2": ("n", 2)}, "event_type", "ts", fill={"v": 2.0}).select(
        "event_type", "ts", "v", "lag_1", "lag_3", F.coalesce("n_2", F.lit(0).cast("long")).alias("n_2")
    )
