"""Buckets, summaries and equi-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.domain import coupling
from seriesloom.operators import stats
from seriesloom.operators.ensemble import with_weights
from seriesloom.operators.resample import grid, resample, resample_full
from seriesloom.plans import feed_review
from workload.registry import R, n, query, r
from workload.series import SCENARIO_SQL, draws, events, gappy, kp, mag, monthly_by_nation, plasma, table


@query(
    "bucket_mean_min",
    f"""SELECT user_id, time_bucket(INTERVAL 3 HOUR, ts) AS ts, {R('avg(value)')} AS v_mean,
    min(value) AS v_min, count(*) AS n FROM events GROUP BY 1, 2""",
)
def bucket_mean_min(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    aggs = [r(F.avg("value")).alias("v_mean"), F.min("value").alias("v_min"), F.count(F.lit(1)).alias("n")]
    return resample(ev, "ts", "3 hours", aggs, "user_id")


@query(
    "bucket_mean_keep_empty",
    f"""WITH g AS (SELECT user_id, time_bucket(INTERVAL 3 HOUR, ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2),
    axis AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 3 HOUR)) AS ts FROM g GROUP BY 1)
    SELECT user_id, ts, {R('v')} AS v_mean FROM axis LEFT JOIN g USING (user_id, ts)""",
)
def bucket_mean_keep_empty(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return resample_full(ev, "ts", "3 hours", [r(F.avg("value")).alias("v_mean")], "user_id")


@query(
    "bucket_grid",
    """SELECT series_id, unnest(generate_series(min(time_tag), max(time_tag), INTERVAL 3 HOUR)) AS time_tag
    FROM gappy GROUP BY 1""",
)
def bucket_grid(spark, sf_dir):
    return grid(gappy(spark, sf_dir), "time_tag", "3 hours", "series_id")


@query(
    "mean_of_minute_coupling",
    f"""SELECT series_id, time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag,
    {R('avg(pow(speed, 4.0e0/3) * pow(bt, 2.0e0/3) * pow(sin(atan2(abs(by_gsm), bz_gsm) / 2), 8.0e0/3))', 2)} AS coupling_mean
    FROM plasma JOIN mag USING (series_id, time_tag) GROUP BY 1, 2""",
)
def mean_of_minute_coupling(spark, sf_dir):
    both = plasma(spark, sf_dir).join(mag(spark, sf_dir), ["series_id", "time_tag"])
    value = r(F.avg(coupling("speed", "bt", "by_gsm", "bz_gsm")), 2)
    return resample(both, "time_tag", "3 hours", [value.alias("coupling_mean")], "series_id")


@query(
    "spread_per_series",
    f"""SELECT user_id, {R('avg(value)')} AS mean, min(value) AS min, max(value) AS max,
    {R('stddev_pop(value)')} AS std_pop FROM events GROUP BY 1""",
)
def spread_per_series(spark, sf_dir):
    out = stats.spread(table(spark, sf_dir, "events"), "value", "user_id")
    return out.select("user_id", r("mean").alias("mean"), "min", "max", r("std_pop").alias("std_pop"))


def _describe_sql(source: str, column: str, keys: str = "") -> str:
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}'{column}' AS "column", count({column}) AS count, {R(f'avg({column})')} AS mean,
    {R(f'stddev_samp({column})')} AS std, min({column}) AS min, {R(f'quantile_cont({column}, 0.25)')} AS p25,
    {R(f'quantile_cont({column}, 0.5)')} AS p50, {R(f'quantile_cont({column}, 0.75)')} AS p75, max({column}) AS max
    FROM {source} {f'GROUP BY {keys}' if keys else ''}"""


def _rounded(df, *keys):
    cols = [r(c).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    return df.select(*keys, "column", n("count").alias("count"), "min", "max", *cols)


@query(
    "describe_table",
    " UNION ALL ".join(_describe_sql("lineitem", c) for c in ("l_extendedprice", "l_quantity", "l_discount")),
)
def describe_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return _rounded(stats.describe(li, ["l_extendedprice", "l_quantity", "l_discount"]))


@query("describe_by_series", _describe_sql("events", "value", "event_type"))
def describe_by_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return _rounded(stats.describe(ev, ["value"], "event_type"), "event_type")


@query(
    "null_counts",
    """SELECT 'a' AS "column", count(*) - count(CASE WHEN event_type <> 'click' THEN value END) AS nulls, count(*) AS "rows" FROM events
    UNION ALL SELECT 'value', count(*) - count(value), count(*) FROM events
    UNION ALL SELECT 'props', count(*) - count(props), count(*) FROM events""",
)
def null_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumn("a", F.when(F.col("event_type") != "click", F.col("value")))
    return stats.null_profile(ev, ["a", "value", "props"])


@query(
    "time_range_per_series",
    'SELECT user_id, count(*) AS "rows", min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1',
)
def time_range_per_series(spark, sf_dir):
    return stats.time_range(table(spark, sf_dir, "events"), "ts", "user_id")


@query(
    "condition_shares",
    f"""SELECT series_id, count(*) AS "rows", CAST(count_if(bz_gsm < -2) AS BIGINT) AS southward_rows,
    {R('count_if(bz_gsm < -2) / count(*)')} AS southward_share, CAST(count_if(speed > 360) AS BIGINT) AS fast_rows,
    {R('count_if(speed > 360) / count(*)')} AS fast_share FROM hourly GROUP BY 1""",
)
def condition_shares(spark, sf_dir):
    from workload.series import hourly

    out = stats.condition_share(
        hourly(spark, sf_dir), {"southward": F.col("bz_gsm") < -2, "fast": F.col("speed") > 360}, "series_id"
    )
    shares = [r(c).alias(c) for c in ("southward_share", "fast_share")]
    return out.select("series_id", "rows", "southward_rows", "fast_rows", *shares)


@query(
    "peak_month",
    """SELECT series_id, time_tag AS peak_time, ssn AS peak_value FROM (SELECT *,
    row_number() OVER (PARTITION BY series_id ORDER BY ssn DESC, time_tag) AS k FROM monthly_by_nation) WHERE k = 1""",
)
def peak_month(spark, sf_dir):
    return stats.peak_row(monthly_by_nation(spark, sf_dir), "ssn", "time_tag", "series_id")


@query(
    "mean_across_columns",
    f"""SELECT event_id, {R('CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END')} AS mean
    FROM (SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN value END AS a, CASE WHEN event_type NOT IN ('view', 'error') THEN value * 2 END AS b FROM events)""",
)
def mean_across_columns(spark, sf_dir):
    a = F.when(~F.col("event_type").isin("click", "view"), F.col("value"))
    b = F.when(~F.col("event_type").isin("view", "error"), F.col("value") * 2)
    return table(spark, sf_dir, "events").select("event_id", r(stats.row_mean(a, b)).alias("mean"))


@query("join_two_feeds", "SELECT series_id, time_tag, speed, density, temperature, by_gsm, bz_gsm, bt FROM plasma JOIN mag USING (series_id, time_tag)")
def join_two_feeds(spark, sf_dir):
    return plasma(spark, sf_dir).join(mag(spark, sf_dir), ["series_id", "time_tag"])


THREE = """(SELECT series_id, time_tag, speed, bz_gsm, "Kp" FROM
    (SELECT series_id, time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag, max(speed) AS speed FROM plasma GROUP BY 1, 2)
    JOIN (SELECT series_id, time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag, min(bz_gsm) AS bz_gsm FROM mag GROUP BY 1, 2)
    USING (series_id, time_tag) JOIN kp USING (series_id, time_tag))"""


@query("join_three_feeds", f"SELECT * FROM {THREE}")
def join_three_feeds(spark, sf_dir):
    p = resample(plasma(spark, sf_dir), "time_tag", "3 hours", [F.max("speed").alias("speed")], "series_id")
    m = resample(mag(spark, sf_dir), "time_tag", "3 hours", [F.min("bz_gsm").alias("bz_gsm")], "series_id")
    return feed_review.aligned([p, m, kp(spark, sf_dir)], "series_id")


@query(
    "left_join_on_bucket",
    """SELECT g.series_id, g.time_tag, g.v, "Kp" FROM (SELECT series_id, time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag,
    max(speed) AS v FROM plasma GROUP BY 1, 2) g LEFT JOIN kp USING (series_id, time_tag)""",
)
def left_join_on_bucket(spark, sf_dir):
    p = resample(plasma(spark, sf_dir), "time_tag", "3 hours", [F.max("speed").alias("v")], "series_id")
    return p.join(kp(spark, sf_dir), ["series_id", "time_tag"], "left")


@query(
    "buckets_with_target",
    f"""SELECT series_id, time_tag, {R('speed_mean')} AS speed_mean, "Kp" FROM (SELECT series_id,
    time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag, avg(speed) AS speed_mean FROM plasma GROUP BY 1, 2)
    JOIN kp USING (series_id, time_tag) WHERE speed_mean IS NOT NULL AND "Kp" IS NOT NULL""",
)
def buckets_with_target(spark, sf_dir):
    aggs = [F.avg("speed").alias("speed_mean")]
    p = resample(plasma(spark, sf_dir), "time_tag", "3 hours", aggs, "series_id")
    out = p.join(kp(spark, sf_dir), ["series_id", "time_tag"]).na.drop("any")
    return out.withColumn("speed_mean", r("speed_mean"))


@query(
    "attach_weights",
    """SELECT scenario, draw, step, kp, CASE scenario WHEN 'Quiet' THEN 0.2 WHEN 'Moderate' THEN 0.5 ELSE 0.3 END::DOUBLE AS weight
    FROM draws""",
)
def attach_weights(spark, sf_dir):
    return with_weights(draws(spark, sf_dir), {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.3})


@query(
    "attach_weight_table",
    f"""SELECT scenario, draw, step, kp, {R('weight', 6)} AS weight FROM draws JOIN (
    SELECT {SCENARIO_SQL} AS scenario, avg(value) / 100 AS weight FROM events GROUP BY 1) USING (scenario)""",
)
def attach_weight_table(spark, sf_dir):
    from workload.series import scenario_name

    every = events(spark, sf_dir).withColumn("scenario", scenario_name())
    weights = every.groupBy("scenario").agg((F.avg("value") / 100).alias("weight"))
    out = with_weights(draws(spark, sf_dir), weights)
    return out.withColumn("weight", r("weight", 6)).select("scenario", "draw", "step", "kp", "weight")


@query(
    "feed_completeness",
    """SELECT 'plasma' AS feed, count(*) AS "rows", count(*) * 4 AS cells, 4 * count(*) - count(series_id) - count(speed) - count(density) - count(temperature) AS null_cells,
    min(time_tag) AS first_time, max(time_tag) AS last_time FROM plasma UNION ALL
    SELECT 'kp', count(*), count(*) * 2, 2 * count(*) - count(series_id) - count("Kp"), min(time_tag), max(time_tag) FROM kp""",
)
def feed_completeness(spark, sf_dir):
    return feed_review.completeness({"plasma": plasma(spark, sf_dir), "kp": kp(spark, sf_dir)})


def _feed_sql(feed: str, column: str) -> str:
    return f"SELECT '{feed}' AS feed, * FROM ({_describe_sql(feed, column)})"


@query(
    "feed_summaries",
    " UNION ALL ".join([_feed_sql("plasma", "speed"), _feed_sql("plasma", "density"), _feed_sql("mag", "bz_gsm")]),
)
def feed_summaries(spark, sf_dir):
    feeds = {
        "plasma": plasma(spark, sf_dir).select("time_tag", "speed", "density"),
        "mag": mag(spark, sf_dir).select("time_tag", "bz_gsm"),
    }
    return _rounded(feed_review.summaries(feeds), "feed")


@query(
    "standardised_columns",
    f"""SELECT series_id, time_tag, {R('(speed - avg(speed) OVER ()) / stddev_pop(speed) OVER ()')} AS speed,
    {R('(bz_gsm - avg(bz_gsm) OVER ()) / stddev_pop(bz_gsm) OVER ()')} AS bz_gsm FROM hourly""",
)
def standardised_columns(spark, sf_dir):
    from workload.series import hourly

    df = hourly(spark, sf_dir).select("series_id", "time_tag", "speed", "bz_gsm")
    out = stats.standardise(df, ["speed", "bz_gsm"])
    return out.select("series_id", "time_tag", r("speed").alias("speed"), r("bz_gsm").alias("bz_gsm"))
