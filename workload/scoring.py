"""Splits, verification, ensembles and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import ensemble, quality, splits, verify
from seriesloom.operators.model import fold_summary
from seriesloom.operators.windows import even_span
from workload.registry import R, n, query, r
from workload.series import draws, ev3h_by_type, hourly, kp, mag, monthly_by_nation, pairs, paths, plasma, table

WEIGHTS = {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.3}
WEIGHT = "CASE scenario WHEN 'Quiet' THEN 0.2e0 WHEN 'Moderate' THEN 0.5e0 ELSE 0.3e0 END"


@query(
    "time_split",
    """SELECT series_id, time_tag, CAST(row_number() OVER (PARTITION BY series_id ORDER BY time_tag) - 1 <
    greatest(1, least(CAST(floor(0.75e0 * count(*) OVER (PARTITION BY series_id)) AS BIGINT), count(*) OVER (PARTITION BY series_id) - 1)) AS INTEGER) AS is_train
    FROM ev3h_by_type""",
)
def time_split(spark, sf_dir):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    out = splits.time_split(df, 0.75, "series_id", "time_tag")
    return out.withColumn("is_train", F.col("is_train").cast("int"))


@query(
    "time_split_raw_events",
    """SELECT event_type, count_if(k < c)::BIGINT AS train_rows, count_if(k >= c)::BIGINT AS test_rows, min(CASE WHEN k >= c THEN ts END) AS test_start FROM (
    SELECT event_type, ts, row_number() OVER w - 1 AS k, greatest(12, least(CAST(floor(0.85e0 * count(*) OVER p) AS BIGINT), count(*) OVER p - 12)) AS c
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts), p AS (PARTITION BY event_type)) GROUP BY 1""",
)
def time_split_raw_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "ts")
    out = splits.time_split(ev, 0.85, "event_type", "ts", 12, 12, span=even_span(ev, "event_type", "ts"))
    return out.groupBy("event_type").agg(
        F.count_if("is_train").alias("train_rows"),
        F.count_if(~F.col("is_train")).alias("test_rows"),
        F.min(F.when(~F.col("is_train"), F.col("ts"))).alias("test_start"),
    )


def _folds_sql(source: str, limit: str = "n") -> str:
    return f"""SELECT series_id, fold, CAST(count_if(k < first - 3) AS BIGINT) AS train_rows, CAST(count_if(k >= first) AS BIGINT) AS test_rows,
    max(CASE WHEN k < first - 3 THEN time_tag END) AS train_end, min(CASE WHEN k >= first THEN time_tag END) AS test_start FROM (
      SELECT *, n - (5 - fold) * (n // 6) AS first FROM (
        SELECT series_id, time_tag, k - (n0 - n) AS k, n, fold FROM (
          SELECT *, least({limit}, n0) AS n FROM (SELECT series_id, time_tag, row_number() OVER (PARTITION BY series_id ORDER BY time_tag) - 1 AS k,
            count(*) OVER (PARTITION BY series_id) AS n0 FROM {source}) WHERE n0 >= 160), range(0, 5) AS f(fold)) WHERE k >= 0)
    WHERE (k < first - 3 OR (k >= first AND k < first + n // 6)) AND first - 3 >= 10 AND n // 6 >= 5 GROUP BY 1, 2"""


def _fold_table(df):
    return df.groupBy("series_id", n("fold").alias("fold")).agg(
        F.count_if("is_train").alias("train_rows"),
        F.count_if(~F.col("is_train")).alias("test_rows"),
        F.max(F.when(F.col("is_train"), F.col("time_tag"))).alias("train_end"),
        F.min(F.when(~F.col("is_train"), F.col("time_tag"))).alias("test_start"),
    )


@query("expanding_folds", _folds_sql("ev3h_by_type", "n0"))
def expanding_folds(spark, sf_dir):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    return _fold_table(splits.expanding_folds(df, 5, 3, "series_id", "time_tag"))


@query("expanding_folds_recent_rows", _folds_sql("ev3h_by_type", "150"))
def expanding_folds_recent_rows(spark, sf_dir):
    df = ev3h_by_type(spark, sf_dir).select("series_id", "time_tag")
    return _fold_table(splits.expanding_folds(df, 5, 3, "series_id", "time_tag", max_rows=150))


def _r2(y: str, p: str) -> str:
    return f"1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count({y}))"


@query(
    "regression_scores",
    f"""SELECT series_id, count(*) AS "rows", {R('avg(abs(y - p))')} AS mae, {R(_r2('y', 'p'))} AS r2 FROM pairs GROUP BY 1""",
)
def regression_scores(spark, sf_dir):
    out = verify.regression_scores(pairs(spark, sf_dir), "y", "p", "series_id")
    return out.select("series_id", "rows", r("mae").alias("mae"), r("r2").alias("r2"))


@query(
    "persistence_scores",
    f"""SELECT series_id, count(*) AS "rows", {R('avg(abs(y - lag1))')} AS mae, {R(_r2('y', 'lag1'))} AS r2,
    {R('CASE WHEN count_if(y >= 5 OR lag1 >= 5) > 0 THEN count_if(y >= 5 AND lag1 >= 5) / count_if(y >= 5 OR lag1 >= 5) ELSE 0.0 END')} AS csi
    FROM pairs GROUP BY 1""",
)
def persistence_scores(spark, sf_dir):
    p = pairs(spark, sf_dir)
    seen, said = F.col("y") >= 5, F.col("lag1") >= 5
    events = F.count_if(seen | said)
    csi = F.when(events > 0, F.count_if(seen & said) / events).otherwise(F.lit(0.0))
    return p.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"),
        r(verify.mae("y", "lag1")).alias("mae"),
        r(verify.r2("y", "lag1")).alias("r2"),
        r(csi).alias("csi"),
    )


SPLIT = """(SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time_tag) - 1 < greatest(1, least(
    CAST(floor(0.75e0 * count(*) OVER (PARTITION BY series_id)) AS BIGINT), count(*) OVER (PARTITION BY series_id) - 1)) AS is_train FROM pairs)"""


@query(
    "mean_baseline_and_skill",
    f"""SELECT series_id, {R('b')} AS baseline_mae, {R('m')} AS mae, {R('q')} AS persistence_mae, {R('m / q')} AS skill_ratio, {R('100 * (1 - m / b)')} AS improvement_pct FROM (
    SELECT t.series_id, avg(abs(y - base)) AS b, avg(abs(y - p)) AS m, avg(abs(y - lag1)) AS q FROM {SPLIT} t JOIN (
      SELECT series_id, avg(y) AS base FROM {SPLIT} WHERE is_train GROUP BY 1) USING (series_id) WHERE NOT is_train GROUP BY 1)""",
)
def mean_baseline_and_skill(spark, sf_dir):
    split = splits.time_split(pairs(spark, sf_dir), 0.75, "series_id", "time_tag")
    test = verify.with_train_mean(split, "y", "base", "series_id")
    scores = test.groupBy("series_id").agg(
        verify.mae("y", "base").alias("baseline_mae"),
        verify.mae("y", "p").alias("mae"),
        verify.mae("y", "lag1").alias("persistence_mae"),
    )
    out = verify.skill(scores)
    return out.select("series_id", *[r(c).alias(c) for c in out.columns if c != "series_id"])


@query(
    "pooled_mean_baseline",
    f"""SELECT count(*) AS "rows", {R(f'avg(abs(y - (SELECT avg(y) FROM {SPLIT} WHERE is_train)))')} AS baseline_mae FROM {SPLIT} WHERE NOT is_train""",
)
def pooled_mean_baseline(spark, sf_dir):
    split = splits.time_split(pairs(spark, sf_dir), 0.75, "series_id", "time_tag")
    test = verify.with_train_mean(split, "y", "base")
    return test.agg(F.count(F.lit(1)).alias("rows"), r(verify.mae("y", "base")).alias("baseline_mae"))


@query(
    "event_contingency",
    f"""SELECT series_id, tp, fp, fn, tn, {R('CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END')} AS csi,
    {R('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS pod, {R('CASE WHEN tp + fp > 0 THEN fp / (tp + fp) END')} AS far FROM (
      SELECT series_id, count_if(y >= 5 AND p >= 5)::BIGINT AS tp, count_if(y < 5 AND p >= 5)::BIGINT AS fp, count_if(y >= 5 AND p < 5)::BIGINT AS fn,
      count_if(y < 5 AND p < 5)::BIGINT AS tn FROM pairs GROUP BY 1)""",
)
def event_contingency(spark, sf_dir):
    out = verify.contingency(pairs(spark, sf_dir), "y", "p", 5.0, "series_id")
    return out.withColumns({c: r(c) for c in ("csi", "pod", "far")})


@query(
    "error_by_regime",
    f"""SELECT series_id, CASE WHEN y >= 5 THEN 'storm' ELSE 'quiet' END AS regime, count(*) AS "rows", {R('avg(abs(y - p))')} AS mae
    FROM pairs GROUP BY 1, 2""",
)
def error_by_regime(spark, sf_dir):
    return verify.regime_scores(pairs(spark, sf_dir), "y", "p", 5.0, "series_id").withColumn("mae", r("mae"))


@query(
    "residual_spread",
    f"SELECT series_id, {R('avg(y - p)')} AS mean_residual, {R('stddev_pop(y - p)')} AS std_residual FROM pairs GROUP BY 1",
)
def residual_spread(spark, sf_dir):
    out = verify.residual_spread(pairs(spark, sf_dir), "y", "p", "series_id")
    return out.withColumns({c: r(c) for c in ("mean_residual", "std_residual")})


def _hist_sql(source: str, value: str, bins: int, key: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    head = f"{key}, " if key else ""
    group = f"{key}, bin" if key else "bin"
    return f"""SELECT {head}bin, count(*) AS "rows", {R('min(lo + bin * w)')} AS left_edge FROM (
      SELECT *, CAST(least(floor((v - lo) / w), {bins - 1}) AS BIGINT) AS bin FROM (SELECT {head}v, lo, (hi - lo) / {bins} AS w FROM (
        SELECT {head}{value} AS v, min({value}) OVER ({part}) AS lo, max({value}) OVER ({part}) AS hi FROM {source}))) GROUP BY {group}"""


@query("residual_histogram", _hist_sql("pairs", "(y - p)", 30, "series_id"))
def residual_histogram(spark, sf_dir):
    out = verify.histogram(pairs(spark, sf_dir), F.col("y") - F.col("p"), 30, "series_id")
    return out.withColumn("left_edge", r("left_edge"))


@query("pooled_histogram", _hist_sql("events", "value", 50, ""))
def pooled_histogram(spark, sf_dir):
    out = verify.histogram(table(spark, sf_dir, "events"), "value", 50)
    return out.withColumn("left_edge", r("left_edge"))


@query(
    "probability_reliability",
    f"""SELECT CAST(least(floor(p / 9 * 10), 9) AS BIGINT) AS bin, count(*) AS "rows", {R('avg(p / 9)')} AS mean_forecast,
    {R('avg(CASE WHEN y >= 5 THEN 1.0 ELSE 0.0 END)')} AS observed_frequency FROM pairs GROUP BY 1""",
)
def probability_reliability(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("probability", F.col("p") / 9)
    out = verify.reliability(df, "probability", F.col("y") >= 5)
    return out.withColumns({c: r(c) for c in ("mean_forecast", "observed_frequency")})


@query(
    "equal_accuracy_test",
    f"""SELECT series_id, n AS "rows", {R('m')} AS mean_loss_difference, {R('CASE WHEN v > 0 THEN m / sqrt(v / n) END', 3)} AS dm_statistic FROM (
      SELECT series_id, any_value(n) AS n, any_value(m) AS m, sum((d - m) * (d - m)) / any_value(n)
        + 2 * sum((d - m) * (d1 - m)) / any_value(n) + 2 * sum((d - m) * (d2 - m)) / any_value(n) AS v FROM (
        SELECT series_id, d, count(*) OVER (PARTITION BY series_id) AS n, avg(d) OVER (PARTITION BY series_id) AS m, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2
        FROM (SELECT series_id, time_tag, abs(y - p) - abs(y - lag1) AS d FROM pairs) WINDOW w AS (PARTITION BY series_id ORDER BY time_tag)) GROUP BY 1)""",
)
def equal_accuracy_test(spark, sf_dir):
    out = verify.diebold_mariano(pairs(spark, sf_dir), "y", "p", "lag1", "series_id", "time_tag", horizon=3)
    return out.withColumns({"mean_loss_difference": r("mean_loss_difference"), "dm_statistic": r("dm_statistic", 3)})


@query(
    "forecast_pairs",
    """SELECT a.series_id, a.time_tag, a.y AS kp_true, b."Kp" AS kp_pred FROM (SELECT event_type AS series_id, time_tag, y FROM (
    SELECT series_id AS event_type, time_tag, y FROM pairs)) a JOIN (SELECT 'error' AS series_id, time_tag, max("Kp") AS "Kp" FROM kp GROUP BY 2) b USING (series_id, time_tag)""",
)
def forecast_pairs(spark, sf_dir):
    seen = pairs(spark, sf_dir).select("series_id", "time_tag", F.col("y").alias("kp_true"))
    made = kp(spark, sf_dir).groupBy("time_tag").agg(F.max("Kp").alias("kp_pred"))
    return seen.join(made.withColumn("series_id", F.lit("error")), ["series_id", "time_tag"])


SUMMARY = ", ".join(
    f"{R(f'avg({c})')} AS {c}_mean, {R(f'stddev_pop({c})')} AS {c}_std, {R(f'1.96 * stddev_pop({c}) / sqrt(count(*))')} AS {c}_ci95" for c in ("mae", "r2", "csi")
)


@query(
    "fold_score_summary",
    f"""SELECT count(*) AS folds, {SUMMARY} FROM (
    SELECT series_id, avg(abs(y - p)) AS mae, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2,
    CASE WHEN count_if(y >= 5 OR p >= 5) = 0 THEN 0.0 ELSE count_if(y >= 5 AND p >= 5)::DOUBLE / count_if(y >= 5 OR p >= 5) END AS csi FROM pairs GROUP BY 1)""",
)
def fold_score_summary(spark, sf_dir):
    """All three scores; the series stand for the folds."""
    rows = pairs(spark, sf_dir)
    scores = verify.regression_scores(rows, "y", "p", "series_id")
    events = verify.contingency(rows, "y", "p", 5.0, "series_id").select("series_id", "csi")
    out = fold_summary(scores.join(events, "series_id"))
    return out.withColumns({c: r(c) for c in out.columns if c != "folds"})


@query(
    "scenario_summary",
    f"""SELECT scenario, count(*) AS "rows", {R('avg(kp)')} AS mean_value, max(kp) AS peak_value, count_if(kp >= 5)::BIGINT AS storm_rows,
    count_if(kp >= 7)::BIGINT AS severe_rows, min(CASE WHEN kp >= 5 THEN time_tag END) AS first_storm FROM paths GROUP BY 1""",
)
def scenario_summary(spark, sf_dir):
    return ensemble.scenario_summary(paths(spark, sf_dir), "kp", "time_tag").withColumn("mean_value", r("mean_value"))


@query(
    "weighted_path",
    f"SELECT step, {R(f'sum(kp * {WEIGHT}) / sum({WEIGHT})')} AS kp FROM paths GROUP BY 1",
)
def weighted_path(spark, sf_dir):
    return ensemble.weighted_by_step(paths(spark, sf_dir), "kp", WEIGHTS).withColumn("kp", r("kp"))


@query("scenario_envelope", "SELECT step, min(kp) AS low, max(kp) AS high FROM paths GROUP BY 1")
def scenario_envelope(spark, sf_dir):
    return ensemble.envelope(paths(spark, sf_dir), "kp")


@query(
    "storm_probability_by_step",
    f"""SELECT step, {R(f'sum(p * {WEIGHT}) / sum({WEIGHT})')} AS probability FROM (
    SELECT scenario, step, avg(CASE WHEN kp >= 5 THEN 1.0 ELSE 0.0 END) AS p FROM draws GROUP BY 1, 2) GROUP BY 1""",
)
def storm_probability_by_step(spark, sf_dir):
    out = ensemble.exceedance_by_step(draws(spark, sf_dir), "kp", WEIGHTS)
    return out.withColumn("probability", r("probability"))


@query(
    "storm_probability_any_step",
    f"""SELECT {R('p')} AS probability, k AS draws, {R('sqrt(p * (1 - p) / k)', 6)} AS standard_error, CAST(p > 0 AND p < 0.02 AS INTEGER) AS low_probability FROM (
    SELECT sum(p * {WEIGHT}) / sum({WEIGHT}) AS p, min(k) AS k FROM (
      SELECT scenario, avg(CASE WHEN m >= 5 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS k FROM (
        SELECT scenario, draw, max(kp) AS m FROM draws GROUP BY 1, 2) GROUP BY 1))""",
)
def storm_probability_any_step(spark, sf_dir):
    from seriesloom.plans.storm_forecast import storm_outlook

    out = storm_outlook(draws(spark, sf_dir), WEIGHTS)
    return out.select(
        r("probability").alias("probability"),
        "draws",
        r("standard_error", 6).alias("standard_error"),
        F.col("low_probability").cast("int").alias("low_probability"),
    )


def _audit(df):
    return df.withColumn("observed", r("observed", 3))


NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _feed_sql(feed: str) -> str:
    return f"""SELECT '{feed}' AS feed, 'not_empty' AS "check", CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END AS status, count(*)::DOUBLE AS observed, '> 0' AS "limit" FROM {feed}
      UNION ALL SELECT '{feed}', 'fresh', CASE WHEN a <= 6 THEN 'ok' ELSE 'warning' END, a, '<= 6 h' FROM (SELECT (epoch_us({NOW}) - epoch_us(max(time_tag))) / 3600000000.0e0 AS a FROM {feed})"""


@query(
    "feed_audit",
    f"""SELECT feed, "check", status, {R('observed', 3)} AS observed, "limit" FROM (
      {_feed_sql('plasma')} UNION ALL {_feed_sql('mag')} UNION ALL {_feed_sql('kp')}
      UNION ALL SELECT 'plasma', 'speed_min', CASE WHEN min(speed) >= 100 THEN 'ok' ELSE 'warning' END, min(speed), '>= 100' FROM plasma
      UNION ALL SELECT 'plasma', 'speed_max', CASE WHEN max(speed) <= 2000 THEN 'ok' ELSE 'warning' END, max(speed), '<= 2000' FROM plasma)""",
)
def feed_audit(spark, sf_dir):
    """All three feeds."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    always = [quality.not_empty(), quality.fresh("time_tag", now)]
    more = {plasma: quality.in_range("speed", 100, 2000), mag: [], kp: []}
    parts = [
        quality.audit(feed(spark, sf_dir), [*always, *extra]).select(F.lit(feed.__name__).alias("feed"), "*") for feed, extra in more.items()
    ]
    return _audit(parts[0].unionByName(parts[1]).unionByName(parts[2]))


ARCHIVE_COLUMNS = ["time_tag", "speed", "density", "by_gsm", "bz_gsm", "bt", "kp"]
PRESENT = " ".join(
    f"UNION ALL SELECT series_id, '{c}_present', CASE WHEN count({c}) > 0 THEN 'ok' ELSE 'error' END, count({c})::DOUBLE, '> 0' FROM hourly GROUP BY 1" for c in ARCHIVE_COLUMNS
)


@query(
    "archive_columns",
    f"SELECT unnest({[*ARCHIVE_COLUMNS, 'station_count']!r}) AS \"check\", unnest({['ok'] * 7 + ['error']!r}) AS status",
)
def archive_columns(spark, sf_dir):
    """Required columns against the schema; the last one is missing."""
    return quality.column_audit(hourly(spark, sf_dir), [*ARCHIVE_COLUMNS, "station_count"])


@query(
    "archive_audit",
    f"""SELECT series_id, "check", status, {R('observed', 3)} AS observed, "limit" FROM (
      SELECT series_id, 'min_rows' AS "check", CASE WHEN count(*) >= 700 THEN 'ok' ELSE 'error' END AS status, count(*)::DOUBLE AS observed, '>= 700' AS "limit" FROM hourly GROUP BY 1
      UNION ALL SELECT series_id, 'kp_min', CASE WHEN min(kp) >= 0 THEN 'ok' ELSE 'warning' END, min(kp), '>= 0' FROM hourly GROUP BY 1
      UNION ALL SELECT series_id, 'kp_max', CASE WHEN max(kp) <= 9.5 THEN 'ok' ELSE 'warning' END, max(kp), '<= 9.5' FROM hourly GROUP BY 1
      {PRESENT}
      UNION ALL SELECT series_id, 'expected_events', 'warning', floor(count(*) * 0.25e0 * 0.08e0), 'years >= 8' FROM hourly GROUP BY 1)""",
)
def archive_audit(spark, sf_dir):
    checks = [
        quality.min_rows(700),
        *quality.in_range("kp", 0, 9.5),
        *quality.not_all_null(ARCHIVE_COLUMNS),
        quality.expected_events(years=1),
    ]
    return _audit(quality.audit(hourly(spark, sf_dir), checks, "series_id"))


SIZES = (32, 48, 120)


@query(
    "training_size_audit",
    " UNION ALL ".join(
        f"""SELECT series_id, 'min_rows' AS "check", CASE WHEN count(*) >= {k} THEN 'ok' ELSE 'error' END AS status, count(*)::DOUBLE AS observed, '>= {k}' AS "limit" FROM monthly_by_nation GROUP BY 1"""
        for k in SIZES
    ),
)
def training_size_audit(spark, sf_dir):
    return quality.audit(monthly_by_nation(spark, sf_dir), [quality.min_rows(k) for k in SIZES], "series_id")

