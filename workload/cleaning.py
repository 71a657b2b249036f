"""Cleaning, projections, predicates, sorting and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import clean as c
from seriesloom.operators import clean, stats, windows
from seriesloom.operators.recursive import left_pad, seed_array
from workload.registry import R, n, query, r
from workload.series import ev3h_by_type, events, gappy, kp, table


@query(
    "coerce_numbers",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
    FROM events""",
)
def coerce_numbers(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", c.to_number(text).alias("value"))


@query(
    "parse_times",
    """SELECT event_id, CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts) END AS at,
    CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS shifted FROM events""",
)
def parse_times(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_type") == "signup", "no time").otherwise(stamp)
    return table(spark, sf_dir, "events").select(
        "event_id",
        c.to_time(text).alias("at"),
        c.to_time(F.concat(text, F.lit("+02:00"))).alias("shifted"),
    )


@query(
    "sentinels_to_null",
    f"""SELECT event_id, CASE WHEN abs(v - 999.9e0) > 1e-8 + 1e-5 * 999.9e0 THEN v END AS density,
    CASE WHEN abs(s - 9999.0e0) > 1e-8 + 1e-5 * 9999.0e0 AND abs(s - 99999.9e0) > 1e-8 + 1e-5 * 99999.9e0 THEN s END AS speed
    FROM (SELECT event_id,
      CASE event_type WHEN 'click' THEN 999.9e0 WHEN 'error' THEN 999.905e0 WHEN 'view' THEN 999.95e0 ELSE value END AS v,
      CASE event_type WHEN 'click' THEN 9999.0e0 WHEN 'signup' THEN 99999.9e0 WHEN 'purchase' THEN 9999.2e0 ELSE value END AS s FROM events)""",
)
def sentinels_to_null(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    v = F.when(kind == "click", 999.9).when(kind == "error", 999.905).when(kind == "view", 999.95)
    s = F.when(kind == "click", 9999.0).when(kind == "signup", 99999.9).when(kind == "purchase", 9999.2)
    v, s = v.otherwise(value), s.otherwise(value)
    df = table(spark, sf_dir, "events").select("event_id", v.alias("density"), s.alias("speed"))
    return clean.null_sentinels(df, {"density": (999.9,), "speed": (9999.0, 99999.9)})


HOLES = """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN value END AS a,
    CASE WHEN event_type NOT IN ('view', 'error') THEN value END AS b FROM events"""


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(~F.col("event_type").isin("click", "view"), F.col("value")).alias("a"),
        F.when(~F.col("event_type").isin("view", "error"), F.col("value")).alias("b"),
    )


@query("drop_any_null", f"SELECT * FROM ({HOLES}) WHERE a IS NOT NULL AND b IS NOT NULL")
def drop_any_null(spark, sf_dir):
    return _holes(spark, sf_dir).na.drop("any")


@query("drop_null_in_subset", f"SELECT * FROM ({HOLES}) WHERE a IS NOT NULL")
def drop_null_in_subset(spark, sf_dir):
    return _holes(spark, sf_dir).na.drop("any", subset=["a"])


@query("drop_all_null", f"SELECT * FROM ({HOLES}) WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_all_null(spark, sf_dir):
    return _holes(spark, sf_dir).na.drop("all", subset=["a", "b"])


def _delivered_twice(spark, sf_dir):
    """Every row again from a later snapshot, purchases with another value the second time."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    again = F.when(F.col("event_type") == "purchase", F.col("value") + 1.0).otherwise(F.col("value"))
    first = ev.withColumn("snapshot", F.lit(1))
    both = first.unionByName(ev.withColumn("value", again).withColumn("snapshot", F.lit(2)))
    return both.drop("event_type")


TWICE = """SELECT event_id, ts, value, 1 AS snapshot FROM events UNION ALL
    SELECT event_id, ts, CASE WHEN event_type = 'purchase' THEN value + 1.0 ELSE value END, 2 FROM events"""


@query("dedupe_whole_rows", f"SELECT DISTINCT event_id, ts, value FROM ({TWICE})")
def dedupe_whole_rows(spark, sf_dir):
    return clean.dedupe_exact(_delivered_twice(spark, sf_dir), ["event_id", "ts", "value"])


@query("dedupe_keep_first", "SELECT ts, event_id, value FROM events")
def dedupe_keep_first(spark, sf_dir):
    out = clean.dedupe(_delivered_twice(spark, sf_dir), "ts", ["snapshot"], "first")
    return out.select("ts", "event_id", "value")


@query("dedupe_keep_last", f"SELECT ts, event_id, value FROM ({TWICE}) WHERE snapshot = 2")
def dedupe_keep_last(spark, sf_dir):
    out = clean.dedupe(_delivered_twice(spark, sf_dir), "ts", ["snapshot"], "last")
    return out.select("ts", "event_id", "value")


@query("project_and_rename", "SELECT event_id, ts AS time_tag, value AS speed FROM events")
def project_and_rename(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("time_tag"), F.col("value").alias("speed")
    )


@query(
    "clip_values",
    """SELECT event_id, greatest(20.0, least(100.0, value)) AS both_sides, greatest(0.0, value - 50.0) AS low_only
    FROM events""",
)
def clip_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        c.clip("value", 20.0, 100.0).alias("both_sides"),
        c.clip(F.col("value") - 50.0, low=0.0).alias("low_only"),
    )


@query(
    "unusable_to_zero",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0.0 END AS value FROM events",
)
def unusable_to_zero(spark, sf_dir):
    kind = F.col("event_type")
    broken = F.when(kind == "error", F.lit(float("nan"))).when(kind == "signup", F.lit(float("inf")))
    broken = broken.when(kind.isin("click", "view"), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", c.finite_or_zero(broken).alias("value"))


@query("fill_default", f"SELECT event_id, coalesce(a, 2.0) AS a FROM ({HOLES})")
def fill_default(spark, sf_dir):
    return _holes(spark, sf_dir).select("event_id", F.coalesce("a", F.lit(2.0)).alias("a"))


@query(
    "threshold_filter",
    """SELECT series_id, time_tag, "Kp", CAST("Kp" >= 7 AS INTEGER) AS severe FROM kp WHERE "Kp" >= 5""",
)
def threshold_filter(spark, sf_dir):
    out = kp(spark, sf_dir).where(F.col("Kp") >= 5)
    return out.select("series_id", "time_tag", "Kp", (F.col("Kp") >= 7).cast("int").alias("severe"))


@query("sort_by_time", "SELECT series_id, time_tag, v_mean FROM ev3h_by_type ORDER BY time_tag, series_id")
def sort_by_time(spark, sf_dir):
    out = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag", "v_mean")
    return out.orderBy("time_tag", "series_id")


@query(
    "last_rows_per_series",
    """SELECT series_id, time_tag, value FROM (SELECT event_type AS series_id, ts AS time_tag, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events) WHERE k <= 5""",
)
def last_rows_per_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("time_tag"), "value"
    )
    return windows.tail_rows(ev, 5, "series_id", "time_tag")


@query(
    "last_row_per_series",
    "SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id",
)
def last_row_per_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return windows.last_row(ev, "user_id", "ts")


@query("head_rows", "SELECT event_id, ts, value FROM events ORDER BY ts LIMIT 5")
def head_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "value").orderBy("ts").limit(5)


@query(
    "pad_short_seed",
    f"""SELECT scenario, draw, round(CASE WHEN k >= 3 THEN a3 ELSE 2.0 END, 6) AS v1,
    round(CASE WHEN k >= 2 THEN a2 ELSE 2.0 END, 6) AS v2, round(a1, 6) AS v3 FROM (
      SELECT scenario, draw, count(*) AS k, max(CASE WHEN i = 1 THEN kp END) AS a1, max(CASE WHEN i = 2 THEN kp END) AS a2,
      max(CASE WHEN i = 3 THEN kp END) AS a3 FROM (
        SELECT scenario, draw, kp, row_number() OVER (PARTITION BY scenario, draw ORDER BY step DESC) AS i FROM draws)
      WHERE i <= 3 GROUP BY 1, 2)""",
)
def pad_short_seed(spark, sf_dir):
    """All draws; those with events in one or two steps only are padded."""
    from workload.series import draws

    keys = ["scenario", "draw"]
    seeds = seed_array(draws(spark, sf_dir), keys, "step", "kp", 3)
    padded = seeds.select(*keys, left_pad("seed", 3, 2.0).alias("s"))
    return padded.select(*keys, *[F.round(F.col("s")[i], 6).alias(f"v{i + 1}") for i in range(3)])


@query(
    "rank_descending",
    f"SELECT series_id, {R('avg(v_mean)')} AS importance FROM ev3h_by_type GROUP BY 1 ORDER BY 2 DESC, 1",
)
def rank_descending(spark, sf_dir):
    out = ev3h_by_type(spark, sf_dir).groupBy("series_id").agg(r(F.avg("v_mean")).alias("importance"))
    return stats.ranked(out, "series_id", "importance")


@query(
    "union_of_frames",
    """SELECT series_id, time_tag, v_mean, 1 AS part FROM gappy UNION ALL
    SELECT series_id, time_tag, v_mean, 2 FROM ev3h_by_type""",
)
def union_of_frames(spark, sf_dir):
    a = gappy(spark, sf_dir).select("series_id", "time_tag", "v_mean", F.lit(1).alias("part"))
    b = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag", "v_mean", F.lit(2).alias("part"))
    return a.unionByName(b)


@query(
    "bucket_and_minute_floor",
    "SELECT event_id, time_bucket(INTERVAL 3 HOUR, ts) AS bucket, date_trunc('minute', ts) AS minute FROM events",
)
def bucket_and_minute_floor(spark, sf_dir):
    from seriesloom.functions.timeaxis import bucket_start, minute_floor

    ev = events(spark, sf_dir)
    return ev.select(
        n("event_id").alias("event_id"),
        bucket_start("time_tag", "3 hours").alias("bucket"),
        minute_floor("time_tag").alias("minute"),
    )
