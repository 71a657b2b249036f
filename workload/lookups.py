"""Windows and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom._common import interval
from seriesloom.operators import asof, windows
from seriesloom.operators.resample import grid, lookback_join
from seriesloom.operators.windows import over
from workload.registry import R, n, query, r
from workload.series import ev3h_by_type, gappy, kp, monthly_by_nation, table

W = "PARTITION BY series_id ORDER BY time_tag"


@query(
    "row_lags",
    f"""SELECT series_id, time_tag, v_mean, lag(v_mean, 1) OVER ({W}) AS lag_1, lag(v_mean, 2) OVER ({W}) AS lag_2,
    lag(v_mean, 3) OVER ({W}) AS lag_3, lag(v_mean, 216) OVER ({W}) AS lag_216 FROM gappy""",
)
def row_lags(spark, sf_dir):
    df = gappy(spark, sf_dir).select("series_id", "time_tag", "v_mean")
    return windows.lags(df, {f"lag_{k}": ("v_mean", k) for k in (1, 2, 3, 216)}, "series_id", "time_tag")


@query(
    "row_lags_raw_events",
    """SELECT event_id, event_type, ts, lag(value, 1) OVER w AS lag_1, lag(value, 216) OVER w AS lag_216, lead(value, 1) OVER w AS lead_1
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def row_lags_raw_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    shifts = {"lag_1": ("value", 1), "lag_216": ("value", 216), "lead_1": ("value", -1)}
    out = windows.lags(ev, shifts, "event_type", "ts", span=windows.even_span(ev, "event_type", "ts"))
    return out.drop("value")


@query(
    "lag_by_time",
    """SELECT a.series_id, a.time_tag, a.v_mean, b.v_mean AS day_before FROM gappy a LEFT JOIN gappy b
    ON a.series_id = b.series_id AND a.time_tag = b.time_tag + INTERVAL 1 DAY""",
)
def lag_by_time(spark, sf_dir):
    df = gappy(spark, sf_dir).select("series_id", "time_tag", "v_mean")
    return lookback_join(df, df, "time_tag", "1 day", "v_mean", "day_before", "series_id")


@query(
    "monthly_lags",
    "SELECT series_id, time_tag, ssn, "
    + ", ".join(f"lag(ssn, {k}) OVER ({W}) AS ssn_lag_{k}m" for k in (1, 2, 3, 6, 12, 24, 36))
    + " FROM monthly_by_nation",
)
def monthly_lags(spark, sf_dir):
    shifts = {f"ssn_lag_{k}m": ("ssn", k) for k in (1, 2, 3, 6, 12, 24, 36)}
    return windows.lags(monthly_by_nation(spark, sf_dir), shifts, "series_id", "time_tag")


@query(
    "next_value_target",
    f"""SELECT * FROM (SELECT series_id, time_tag, ssn, lead(ssn, 1) OVER ({W}) AS ssn_next FROM monthly_by_nation)
    WHERE ssn_next IS NOT NULL""",
)
def next_value_target(spark, sf_dir):
    out = windows.lags(monthly_by_nation(spark, sf_dir), {"ssn_next": ("ssn", -1)}, "series_id", "time_tag")
    return out.na.drop("any", subset=["ssn_next"])


FILL = f"""(SELECT g.series_id, g.time_tag, v_mean FROM (SELECT series_id, unnest(generate_series(min(time_tag), max(time_tag), INTERVAL 3 HOUR)) AS time_tag
    FROM gappy GROUP BY 1) g LEFT JOIN gappy USING (series_id, time_tag))"""


def _with_holes(spark, sf_dir):
    g = gappy(spark, sf_dir).select("series_id", "time_tag", "v_mean")
    return grid(g, "time_tag", "3 hours", "series_id").join(g, ["series_id", "time_tag"], "left")


@query(
    "forward_fill",
    f"""SELECT series_id, time_tag, last_value(v_mean IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v_mean
    FROM {FILL}""",
)
def forward_fill(spark, sf_dir):
    return windows.ffill(_with_holes(spark, sf_dir), "v_mean", "series_id", "time_tag")


@query(
    "forward_fill_raw_events",
    """SELECT event_id, last_value(CASE WHEN value > 100 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)
def forward_fill_raw_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    ev = ev.withColumn("value", F.when(F.col("value") > 100, F.col("value")))
    return windows.ffill(ev, "value", "event_type", "ts", span=windows.even_span(ev, "event_type", "ts")).select("event_id", "value")


def _lag_fill(k: int) -> str:
    return f"coalesce(last_value(l{k} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2.0) AS lag_{k}"


@query(
    "lag_fill_default",
    f"""SELECT series_id, time_tag, {_lag_fill(1)}, {_lag_fill(2)}, {_lag_fill(3)} FROM (
    SELECT series_id, time_tag, lag(f, 1) OVER ({W}) AS l1, lag(f, 2) OVER ({W}) AS l2, lag(f, 3) OVER ({W}) AS l3 FROM (
      SELECT series_id, time_tag, last_value(v_mean IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {FILL}))""",
)
def lag_fill_default(spark, sf_dir):
    out = windows.lags_filled(
        _with_holes(spark, sf_dir), "v_mean", {f"lag_{k}": k for k in (1, 2, 3)}, "series_id", "time_tag", 2.0
    )
    return out.drop("v_mean")


@query(
    "trailing_means",
    f"""SELECT series_id, time_tag, {R(f'avg(ssn) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS roll3,
    CASE WHEN count(ssn) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 6 THEN
    {R(f'avg(ssn) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)')} END AS roll12 FROM monthly_by_nation""",
)
def trailing_means(spark, sf_dir):
    df = monthly_by_nation(spark, sf_dir)
    out = windows.rolling(df, "ssn", 3, "roll3", "series_id", "time_tag", 1)
    out = windows.rolling(out, "ssn", 12, "roll12", "series_id", "time_tag", 6)
    return out.select("series_id", "time_tag", r("roll3").alias("roll3"), r("roll12").alias("roll12"))


@query(
    "centred_mean",
    f"""SELECT series_id, time_tag, CASE WHEN count(ssn) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) >= 7 THEN
    {R(f'avg(ssn) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)')} END AS smooth FROM monthly_by_nation""",
)
def centred_mean(spark, sf_dir):
    df = monthly_by_nation(spark, sf_dir)
    out = windows.rolling(df, "ssn", 13, "smooth", "series_id", "time_tag", 7, centred=True)
    return out.select("series_id", "time_tag", r("smooth").alias("smooth"))


@query(
    "centred_mean_raw_events",
    """SELECT event_id, CASE WHEN count(value) OVER w >= 7 THEN """
    + R("avg(value) OVER w")
    + """ END AS smooth FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""",
)
def centred_mean_raw_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = windows.rolling(ev, "value", 13, "smooth", "event_type", "ts", 7, centred=True, span=windows.even_span(ev, "event_type", "ts"))
    return out.select("event_id", r("smooth").alias("smooth"))


@query(
    "trailing_min",
    "SELECT scenario, draw, step, min(kp) OVER (PARTITION BY scenario, draw ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low FROM draws",
)
def trailing_min(spark, sf_dir):
    from workload.series import draws

    out = windows.rolling(draws(spark, sf_dir), "kp", 3, "low", ["scenario", "draw"], "step", agg=F.min)
    return out.select("scenario", "draw", "step", "low")


@query(
    "tail_mean_and_last",
    f"""SELECT event_type, {R('avg(value)')} AS tail_mean, arg_max(value, ts) AS last_value FROM (SELECT *,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events) WHERE k <= 10 GROUP BY 1""",
)
def tail_mean_and_last(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return windows.tail_rows(ev, 10, "event_type", "ts").groupBy("event_type").agg(
        r(F.avg("value")).alias("tail_mean"), F.max_by("value", "ts").alias("last_value")
    )


@query(
    "row_index_and_fraction",
    f"""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS row_index,
    {R('(row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1)', 6)} AS row_fraction
    FROM events""",
)
def row_index_and_fraction(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    out = windows.index_fraction(ev, "event_type", "ts", windows.even_span(ev, "event_type", "ts"))
    return out.select("event_id", n("row_index").alias("row_index"), r("row_fraction", 6).alias("row_fraction"))


@query(
    "month_index",
    "SELECT o_orderkey, CAST((year(o_orderdate) - 1749) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month FROM orders",
)
def month_index(spark, sf_dir):
    from seriesloom.functions.timeaxis import month_index as index

    return table(spark, sf_dir, "orders").select("o_orderkey", n(index("o_orderdate")).alias("month"))


def _near_sql(tolerance: str, comparison: str = "<=") -> str:
    """Nearest neighbour by two as-of joins; the later row wins a tie."""
    return f"""
    SELECT series_id, time_tag, coalesce(CASE WHEN d IS NOT NULL AND d {comparison} {tolerance} THEN v END, 2.0) AS found FROM (
      SELECT p.series_id, p.time_tag, CASE WHEN lo.at_time IS NULL OR epoch_us(hi.at_time) - epoch_us(p.probe) <= epoch_us(p.probe) - epoch_us(lo.at_time)
        THEN hi.v ELSE lo.v END AS v,
      CASE WHEN lo.at_time IS NULL OR epoch_us(hi.at_time) - epoch_us(p.probe) <= epoch_us(p.probe) - epoch_us(lo.at_time)
        THEN epoch_us(hi.at_time) - epoch_us(p.probe) ELSE epoch_us(p.probe) - epoch_us(lo.at_time) END AS d
      FROM probes p ASOF LEFT JOIN past lo ON p.series_id = lo.series_id AND p.probe >= lo.at_time
      ASOF LEFT JOIN past hi ON p.series_id = hi.series_id AND p.probe <= hi.at_time)"""


def _probe_views(back: str) -> str:
    return f"""WITH ev3h_by_type_ AS (SELECT * FROM ev3h_by_type),
    past AS (SELECT series_id, time_tag AS at_time, v_mean AS v FROM gappy),
    probes AS (SELECT series_id, time_tag, time_tag - INTERVAL '{back}' AS probe FROM ev3h_by_type_)"""


def _merge_with(head: str, body: str) -> str:
    """The registry puts views in front, so the query's own are nested."""
    names = head.removeprefix("WITH ")
    return f"SELECT * FROM (WITH {names} {body})"


def _probes(spark, sf_dir, back: str):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    past = gappy(spark, sf_dir).select("series_id", F.col("time_tag").alias("at"), "v_mean")
    return df.withColumn("probe", F.col("time_tag") - interval(back)), past


@query("asof_nearest", _merge_with(_probe_views("97 hours 30 minutes"), _near_sql("10800000000")))
def asof_nearest(spark, sf_dir):
    probes, past = _probes(spark, sf_dir, "97 hours 30 minutes")
    out = asof.asof_nearest(probes, past, "probe", "at", "v_mean", "found", "series_id", "3 hours")
    return out.select("series_id", "time_tag", F.coalesce("found", F.lit(2.0)).alias("found"))


@query(
    "asof_nearest_27_days",
    _merge_with(_probe_views("27 days"), _near_sql("10800000000")),
)
def asof_nearest_27_days(spark, sf_dir):
    probes, past = _probes(spark, sf_dir, "27 days")
    out = asof.asof_nearest(probes, past, "probe", "at", "v_mean", "found", "series_id", "3 hours")
    return out.select("series_id", "time_tag", F.coalesce("found", F.lit(2.0)).alias("found"))


@query(
    "asof_nearest_raw_events",
    """SELECT event_id, CASE WHEN d <= 600000000 THEN v END AS value FROM (
      SELECT p.event_id, CASE WHEN lo.ts IS NULL OR epoch_us(hi.ts) - epoch_us(p.ts) <= epoch_us(p.ts) - epoch_us(lo.ts) THEN hi.value ELSE lo.value END AS v,
      CASE WHEN lo.ts IS NULL OR epoch_us(hi.ts) - epoch_us(p.ts) <= epoch_us(p.ts) - epoch_us(lo.ts) THEN epoch_us(hi.ts) - epoch_us(p.ts) ELSE epoch_us(p.ts) - epoch_us(lo.ts) END AS d
      FROM (SELECT * FROM events WHERE event_type = 'click') p
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') lo ON p.ts >= lo.ts
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') hi ON p.ts <= hi.ts)""",
)
def asof_nearest_raw_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    probes = ev.where("event_type = 'click'").select("event_id", "ts")
    past = ev.where("event_type = 'error'").select(F.col("ts").alias("at"), F.col("value").alias("v"))
    out = asof.asof_nearest(probes, past, "ts", "at", "v", "value", (), "10 minutes", span=None)
    return out.select("event_id", "value")


FORWARD = _merge_with(
    _probe_views("97 hours 30 minutes"),
    """SELECT series_id, time_tag, coalesce(CASE WHEN abs(epoch_us(at_time) - epoch_us(probe)) < 10800000000 THEN v END, 2.0) AS found FROM (
      SELECT p.series_id, p.time_tag, p.probe, coalesce(hi.at_time, e.at_time) AS at_time, CASE WHEN hi.at_time IS NULL THEN e.v ELSE hi.v END AS v
      FROM probes p ASOF LEFT JOIN past hi ON p.series_id = hi.series_id AND p.probe <= hi.at_time
      LEFT JOIN (SELECT series_id, max(at_time) AS at_time, arg_max(v, at_time) AS v FROM past GROUP BY 1) e ON p.series_id = e.series_id)""",
)


@query("asof_forward", FORWARD)
def asof_forward(spark, sf_dir):
    probes, past = _probes(spark, sf_dir, "97 hours 30 minutes")
    out = asof.asof_forward(probes, past, "probe", "at", "v_mean", "found", "series_id", "3 hours")
    return out.select("series_id", "time_tag", F.coalesce("found", F.lit(2.0)).alias("found"))


@query(
    "asof_forward_past_the_end",
    FORWARD.replace("- INTERVAL '97 hours 30 minutes'", "+ INTERVAL '2 hours'"),
)
def asof_forward_past_the_end(spark, sf_dir):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    _, past = _probes(spark, sf_dir, "1 hour")
    probes = df.withColumn("probe", F.col("time_tag") + interval("2 hours"))
    out = asof.asof_forward(probes, past, "probe", "at", "v_mean", "found", "series_id", "3 hours")
    return out.select("series_id", "time_tag", F.coalesce("found", F.lit(2.0)).alias("found"))


@query("asof_forward_strict", FORWARD.replace("97 hours 30 minutes", "4 days"))
def asof_forward_strict(spark, sf_dir):
    """Probes on the grid: next to an outage the following row is exactly 3 hours away."""
    probes, past = _probes(spark, sf_dir, "4 days")
    out = asof.asof_forward(probes, past, "probe", "at", "v_mean", "found", "series_id", "3 hours")
    return out.select("series_id", "time_tag", F.coalesce("found", F.lit(2.0)).alias("found"))


@query(
    "recurrence_boost",
    f"""SELECT p.series_id, count(h."Kp") AS found, {R('CASE WHEN avg(h."Kp") IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (avg(h."Kp") - 3) / 4)) END')} AS boost
    FROM (SELECT series_id, unnest(generate_series(m + INTERVAL 3 HOUR, m + INTERVAL 72 HOUR, INTERVAL 3 HOUR)) - INTERVAL 27 DAY AS probe
      FROM (SELECT series_id, max(time_tag) AS m FROM kp GROUP BY 1)) p
    LEFT JOIN kp h ON p.series_id = h.series_id AND p.probe = h.time_tag GROUP BY 1""",
)
def recurrence_boost(spark, sf_dir):
    from seriesloom.functions.timeaxis import time_axis

    seen = kp(spark, sf_dir)
    last = seen.groupBy("series_id").agg(F.max("time_tag").alias("m"))
    axis = last.select("series_id", F.explode(time_axis(F.col("m"), "3 hours", 24)).alias("time_tag"))
    probes = axis.withColumn("probe", F.col("time_tag") - interval("27 days"))
    past = seen.select("series_id", F.col("time_tag").alias("at"), "Kp")
    found = asof.asof_forward(probes, past, "probe", "at", "Kp", "hit", "series_id", "3 hours")
    out = asof.recurrence_boost(found, "hit", "series_id")
    return out.withColumn("boost", r("boost"))


@query(
    "nearest_on_regular_grid",
    """SELECT series_id, time_tag, CASE WHEN lo_at IS NULL OR (hi_at IS NOT NULL AND epoch_us(hi_at) - epoch_us(time_tag) <= epoch_us(time_tag) - epoch_us(lo_at)) THEN hi_v ELSE lo_v END AS value FROM (
      SELECT g.series_id, g.time_tag, lo.time_tag AS lo_at, lo.value AS lo_v, hi.time_tag AS hi_at, hi.value AS hi_v FROM (
        SELECT event_type AS series_id, unnest(generate_series(min(time_bucket(INTERVAL 3 HOUR, ts)), max(time_bucket(INTERVAL 3 HOUR, ts)), INTERVAL 3 HOUR)) AS time_tag FROM events GROUP BY 1) g
      ASOF LEFT JOIN (SELECT event_type AS series_id, ts AS time_tag, value FROM events) lo ON g.series_id = lo.series_id AND g.time_tag >= lo.time_tag
      ASOF LEFT JOIN (SELECT event_type AS series_id, ts AS time_tag, value FROM events) hi ON g.series_id = hi.series_id AND g.time_tag <= hi.time_tag)""",
)
def nearest_on_regular_grid(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("at"), "value"
    )
    axis = grid(ev.withColumnRenamed("at", "time_tag"), "time_tag", "3 hours", "series_id")
    return asof.asof_nearest(
        axis, ev.withColumnRenamed("value", "v"), "time_tag", "at", "v", "value", "series_id", span=None
    )


@query(
    "running_count",
    f"SELECT series_id, time_tag, row_number() OVER ({W}) - 1 AS position FROM ev3h_by_type",
)
def running_count(spark, sf_dir):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    return df.withColumn("position", n(F.row_number().over(over(["series_id"], "time_tag")) - 1))
