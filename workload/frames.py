"""Feature frames as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.config import SEASONAL_FEATURES, STORM_FEATURES, SeasonalConfig
from seriesloom.plans import seasonal, storm_forecast, storm_frames
from workload.registry import R, n, query, r
from workload.scalars import COUPLING
from workload.series import PI, draws, hourly, kp, mag, monthly_by_nation, plasma

W = "PARTITION BY series_id ORDER BY time_tag"
MEAN_COUPLING = COUPLING.replace("speed", "speed_mean").replace("bt", "bt_mean").replace("by_gsm", "by_mean").replace("bz_gsm", "bz_mean")
PHYSICS = f"""{R(MEAN_COUPLING, 2)} AS coupling_mean, {R('density_mean * pow(speed_mean / 100, 2)')} AS p_dyn_mean,
    {R('speed_mean * greatest(0.0, -bz_mean) / 1000')} AS vbs, {R(f'cos(4 * {PI} * (dayofyear(time_tag) - 80) / 365.25e0)')} AS equinox_term"""
MEANS = "avg(speed) AS speed_mean, avg(density) AS density_mean, avg(by_gsm) AS by_mean, avg(bt) AS bt_mean, avg(bz_gsm) AS bz_mean, min(bz_gsm) AS bz_min"
PLAIN = ", ".join(f"{R(c)} AS {c}" for c in ("speed_mean", "density_mean", "by_mean", "bz_mean", "bz_min", "bt_mean"))
KP_LAGS = {"kp_lag_3h": 1, "kp_lag_6h": 2, "kp_lag_9h": 3, "kp_lag_27d": 216}
BUCKET = "time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag"


def _rounded(df, extra=()):
    cols = [r(c, 2 if c == "coupling_mean" else 4).alias(c) for c in STORM_FEATURES]
    return df.select("series_id", "time_tag", *cols, *[r(c).alias(c) for c in extra])


@query(
    "archive_feature_frame",
    f"""SELECT series_id, time_tag, {PLAIN}, {PHYSICS}, {', '.join(f'{R(c)} AS {c}' for c in KP_LAGS)}, {R('"Kp"')} AS "Kp" FROM (
      SELECT *, {', '.join(f'lag("Kp", {k}) OVER ({W}) AS {c}' for c, k in KP_LAGS.items())} FROM (
        SELECT series_id, {BUCKET}, {MEANS}, avg(kp) AS "Kp" FROM hourly GROUP BY 1, 2)) WHERE kp_lag_27d IS NOT NULL""",
)
def archive_feature_frame(spark, sf_dir):
    return _rounded(storm_frames.archive_frame(hourly(spark, sf_dir), "series_id"), ["Kp"])


def _filled(k: int) -> str:
    return f"coalesce(last_value(l{k} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2.0)"


@query(
    "live_feature_frame",
    f"""SELECT series_id, time_tag, {PLAIN}, {PHYSICS}, {R(_filled(1))} AS kp_lag_3h, {R(_filled(2))} AS kp_lag_6h, {R(_filled(3))} AS kp_lag_9h,
    {R('coalesce(k27, 2.0)')} AS kp_lag_27d FROM (
      SELECT *, lag(f, 1) OVER ({W}) AS l1, lag(f, 2) OVER ({W}) AS l2, lag(f, 3) OVER ({W}) AS l3 FROM (
        SELECT *, last_value("Kp" IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM (
          SELECT g.*, kp."Kp", coalesce(h0.v, hn.v, hp.v) AS k27 FROM (
            SELECT series_id, {BUCKET}, {MEANS} FROM plasma JOIN mag USING (series_id, time_tag) GROUP BY 1, 2) g
          LEFT JOIN kp ON g.series_id = kp.series_id AND g.time_tag = kp.time_tag
          LEFT JOIN (SELECT series_id, {BUCKET}, avg(kp) AS v FROM hourly GROUP BY 1, 2) h0 ON h0.series_id = g.series_id AND h0.time_tag = g.time_tag - INTERVAL 27 DAY
          LEFT JOIN (SELECT series_id, {BUCKET}, avg(kp) AS v FROM hourly GROUP BY 1, 2) hn ON hn.series_id = g.series_id AND hn.time_tag = g.time_tag - INTERVAL 27 DAY + INTERVAL 3 HOUR
          LEFT JOIN (SELECT series_id, {BUCKET}, avg(kp) AS v FROM hourly GROUP BY 1, 2) hp ON hp.series_id = g.series_id AND hp.time_tag = g.time_tag - INTERVAL 27 DAY - INTERVAL 3 HOUR)))""",
)
def live_feature_frame(spark, sf_dir):
    history = storm_frames.bucket_means(hourly(spark, sf_dir), "series_id", "time_tag", "kp")
    return _rounded(
        storm_frames.live_frame(
            plasma(spark, sf_dir), mag(spark, sf_dir), kp(spark, sf_dir), history, "series_id"
        )
    )


@query(
    "live_feature_frame_without_history",
    f"""SELECT series_id, time_tag, {PLAIN}, {PHYSICS}, 2.0 AS kp_lag_3h, 2.0 AS kp_lag_6h, 2.0 AS kp_lag_9h, 2.0 AS kp_lag_27d FROM (
    SELECT series_id, {BUCKET}, {MEANS} FROM plasma JOIN mag USING (series_id, time_tag) GROUP BY 1, 2)""",
)
def live_feature_frame_without_history(spark, sf_dir):
    return _rounded(
        storm_frames.live_frame(plasma(spark, sf_dir), mag(spark, sf_dir), None, None, "series_id")
    )


MONTH_LAGS = ", ".join(f"lag(ssn, {k}) OVER ({W}) AS ssn_lag_{k}m" for k in (1, 2, 3, 6, 12, 24, 36))


@query(
    "seasonal_feature_frame",
    f"""SELECT series_id, time_tag, {R('ssn')} AS ssn, {', '.join(f'{R(c)} AS {c}' for c in (*SEASONAL_FEATURES, 'ssn_next'))} FROM (
      SELECT *, sin(2 * {PI} * m / 132) AS sin_11yr, cos(2 * {PI} * m / 132) AS cos_11yr, sin(4 * {PI} * m / 132) AS sin_5p5yr, cos(4 * {PI} * m / 132) AS cos_5p5yr FROM (
        SELECT *, {MONTH_LAGS}, lead(ssn, 1) OVER ({W}) AS ssn_next, (year(time_tag) - 1749) * 12 + month(time_tag) - 1 AS m,
        avg(ssn) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ssn_roll3m,
        CASE WHEN count(ssn) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 6 THEN avg(ssn) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS ssn_roll12m
        FROM monthly_by_nation)) WHERE ssn_lag_36m IS NOT NULL""",
)
def seasonal_feature_frame(spark, sf_dir):
    out = seasonal.seasonal_features(monthly_by_nation(spark, sf_dir), "series_id")
    return out.select("series_id", "time_tag", *[r(c).alias(c) for c in ("ssn", *SEASONAL_FEATURES, "ssn_next")])


PHASE_SQL = f"""SELECT series_id, CASE WHEN x < 30 THEN 'Minimum' WHEN x < 80 THEN 'Rising / Declining' WHEN x < 140 THEN 'Moderate Maximum' ELSE 'High Maximum' END AS tier,
    {R('greatest(0.0, least(1.0, (x - lo) / greatest(hi - lo, 1.0)))', 3)} AS pos FROM (
      SELECT series_id, arg_max(s, time_tag) AS x, min(CASE WHEN time_tag >= TIMESTAMP '1997-01-01' THEN s END) AS lo, max(CASE WHEN time_tag >= TIMESTAMP '1997-01-01' THEN s END) AS hi FROM (
        SELECT series_id, time_tag, avg(ssn) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS s FROM monthly_by_nation) GROUP BY 1)"""


@query("cycle_phase_of_observed", PHASE_SQL)
def cycle_phase_of_observed(spark, sf_dir):
    """Without forecast months."""
    monthly = monthly_by_nation(spark, sf_dir)
    none_ahead = monthly.where("false").withColumn("step", F.lit(0))
    out = seasonal.cycle_phase(monthly, none_ahead, "series_id", SeasonalConfig(cycle_start="1997-01-01"))
    return out.select("series_id", F.col("solar_activity_tier").alias("tier"), F.col("ssn_normalized").alias("pos"))


@query("cycle_phase_with_forecast", PHASE_SQL)
def cycle_phase_with_forecast(spark, sf_dir):
    """The last six months of every series stand for a model's months ahead, so the smoothed level
    is that of the last of them."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("time_tag")))
    months = monthly_by_nation(spark, sf_dir).withColumn("back", back)
    seen = months.where("back > 6").drop("back")
    ahead = months.where("back <= 6").select("series_id", "time_tag", "ssn", (6 - F.col("back")).alias("step"))
    out = seasonal.cycle_phase(seen, ahead, "series_id", SeasonalConfig(cycle_start="1997-01-01"))
    return out.select("series_id", F.col("solar_activity_tier").alias("tier"), F.col("ssn_normalized").alias("pos"))


@query(
    "scenario_step_inputs",
    f"""SELECT scenario, draw, step, {R('bz_mean')} AS bz_mean, {R(f'min(bz_mean) OVER (PARTITION BY scenario, draw ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS bz_min,
    {R(MEAN_COUPLING, 2)} AS coupling_mean, {R('speed_mean * greatest(0.0, -bz_mean) / 1000')} AS vbs FROM (
      SELECT scenario, draw, step, 300 + 10 * kp AS speed_mean, kp - 5 AS bz_mean, abs(kp - 5) + 2 AS bt_mean, kp / 2 AS by_mean FROM draws)""",
)
def scenario_step_inputs(spark, sf_dir):
    d = draws(spark, sf_dir)
    k = F.col("kp")
    start = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    scenarios = d.select(
        "scenario",
        "draw",
        "step",
        (start + F.make_dt_interval(F.lit(0), (F.col("step") * 3).cast("int"))).alias("time_tag"),
        (F.lit(300.0) + k * 10).alias("speed"),
        k.alias("density"),
        (k / 2).alias("by_gsm"),
        (k - 5).alias("bz_gsm"),
        (F.abs(k - 5) + 2).alias("bt"),
    )
    out = storm_forecast.step_inputs(scenarios, None, [], ["scenario", "draw"])
    return out.select(
        "scenario", "draw", n("step").alias("step"), r("bz_mean").alias("bz_mean"), r("bz_min").alias("bz_min"),
        r("coupling_mean", 2).alias("coupling_mean"), r("vbs").alias("vbs"),
    )
