"""Fitted models and recursive forecasts at their full settings.

MLlib's trees have no SQL form. What SQL can say about a result is compared by value: keys, times,
counts and the scores of the references. The rest is compared as flags, computed from the
predictions, that have to be 1.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.config import STORM_FEATURES, SeasonalConfig, StormConfig
from seriesloom.functions.domain import adjusted_weights
from seriesloom.functions.timeaxis import time_axis
from seriesloom.operators import model as m
from seriesloom.operators import windows
from seriesloom.operators.ensemble import exceedance_by_step
from seriesloom.operators.splits import time_split
from seriesloom.operators.verify import with_train_mean
from seriesloom.plans import reports, seasonal, storm_forecast, storm_frames
from seriesloom.session import fresh_path, written
from workload.registry import R, n, query, r
from workload.series import (
    events,
    hourly,
    k_of,
    kp,
    mag,
    monthly_by_nation,
    plasma,
    scenario_name,
    ship_archive,
)

STORM = StormConfig()
SEASONAL = SeasonalConfig(cycle_start="1997-01-01")

# What a session has written or fitted, by application, kind and table folder.
_made: dict[tuple, object] = {}


def _once(spark, kind: str, sf_dir: str, make):
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _flag(condition: Column, name: str) -> Column:
    return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint")).alias(name)


def _frame(spark, sf_dir) -> DataFrame:
    """Training frame; written once, because fitting reads it many times."""
    return _once(
        spark, "frame", sf_dir,
        lambda: written(storm_frames.archive_frame(ship_archive(spark, sf_dir), "series_id"), "frame"),
    )


def _stored(spark, kind: str, sf_dir: str, settings, train):
    """The session's model of one training setup, through the model store."""
    store = _once(spark, "store", "", lambda: fresh_path(spark, "models"))
    key = m.settings_key(kind=kind, table=sf_dir, **asdict(settings))
    return m.fit_or_load(spark, store, key, train)


def _storm(spark, sf_dir):
    """The storm model and the scored test rows."""

    def make():
        split = written(time_split(_frame(spark, sf_dir), STORM.train_fraction, "series_id", "time_tag"), "split")
        fit = lambda: m.fit(split.where("is_train"), STORM_FEATURES, "Kp", STORM.trees)
        model, _ = _stored(spark, "storm", sf_dir, STORM, fit)
        test = with_train_mean(split, "Kp", "baseline", ["series_id"])
        return model, m.predict(model, test, "Kp_pred")

    return _once(spark, "storm", sf_dir, make)


def _seasonal(spark, sf_dir):
    """Monthly rows, the monthly model and the scored test rows."""

    def make():
        monthly = written(monthly_by_nation(spark, sf_dir), "monthly")
        model, test = seasonal.train_seasonal(monthly, "series_id", SEASONAL)
        return monthly, model, written(test, "months-tested")

    return _once(spark, "seasonal", sf_dir, make)


@query(
    "storm_model_scores",
    f"""SELECT CAST(count(*) AS BIGINT) AS test_count, {R('avg(abs("Kp" - base))')} AS baseline_mae, {R('avg(abs("Kp" - kp_lag_3h))')} AS persistence_mae,
    {R('1 - sum(pow("Kp" - kp_lag_3h, 2)) / (var_pop("Kp") * count(*))')} AS persistence_r2, CAST(1 AS BIGINT) AS better_than_baseline, CAST(1 AS BIGINT) AS better_than_persistence
    FROM ship_split JOIN (SELECT series_id, avg("Kp") AS base FROM ship_split WHERE is_train GROUP BY 1) USING (series_id) WHERE NOT is_train""",
)
def storm_model_scores(spark, sf_dir):
    scores = storm_forecast.storm_scores(_storm(spark, sf_dir)[1])
    return scores.select(
        n("test_count").alias("test_count"), r("baseline_mae").alias("baseline_mae"), r("persistence_mae").alias("persistence_mae"),
        r("persistence_r2").alias("persistence_r2"), _flag(F.col("mae") < F.col("baseline_mae"), "better_than_baseline"),
        _flag(F.col("mae") < F.col("persistence_mae"), "better_than_persistence"),
    )


@query(
    "storm_model_predictions",
    f"""SELECT series_id, time_tag, {R('"Kp"')} AS kp_true, CAST(1 AS BIGINT) AS in_range FROM ship_split WHERE NOT is_train""",
)
def storm_model_predictions(spark, sf_dir):
    test = _storm(spark, sf_dir)[1]
    return test.select("series_id", "time_tag", r("Kp").alias("kp_true"), _flag(F.col("Kp_pred").between(-1.0, 10.0), "in_range"))


@query(
    "cross_validation_scores",
    f"""SELECT CAST(fold AS BIGINT) AS fold, CAST(sum(size) AS BIGINT) AS rows, CAST(1 AS BIGINT) AS scored FROM (
    SELECT series_id, n // 6 AS size, n - (5 - fold) * (n // 6) AS first, fold FROM (
      SELECT series_id, count(*) AS n, unnest(range(5)) AS fold FROM ship_frame GROUP BY 1) WHERE n >= 160)
    WHERE first - 3 >= 10 AND size >= 5 GROUP BY 1""",
)
def cross_validation_scores(spark, sf_dir):
    """Five folds with the number of trees of the configuration's folds."""
    settings = STORM.trees.__class__(**asdict(STORM.trees) | {"trees": STORM.fold_trees})
    frame = _frame(spark, sf_dir)
    scores = m.cross_validate(frame, STORM_FEATURES, "Kp", settings, "series_id", "time_tag", STORM.folds, STORM.fold_gap)
    good = F.col("mae").between(0.0, 9.0) & (F.col("r2") > 0) & F.col("csi").between(0.0, 1.0)
    return scores.select(n("fold").alias("fold"), n("rows").alias("rows"), _flag(good, "scored"))


FEATURES_SQL = f"SELECT unnest([{', '.join(repr(f) for f in STORM_FEATURES)}]) AS feature"


@query(
    "permutation_importance",
    f"""SELECT feature, CASE WHEN tested < 20 THEN 'too few rows' ELSE 'ok' END AS status, CAST(tested >= 20 AS BIGINT) AS finite
    FROM ({FEATURES_SQL}), (SELECT count(*) AS tested FROM ship_split WHERE NOT is_train)""",
)
def permutation_importance(spark, sf_dir):
    """On the held-out rows."""
    model, test = _storm(spark, sf_dir)
    out = m.permutation_importance(model, test, STORM_FEATURES, "Kp", ["series_id", "time_tag"])
    return out.select("feature", "status", _flag(F.col("importance").between(-1.0, 4.0), "finite"))


@query(
    "impurity_importance",
    f"SELECT feature, CAST(1 AS BIGINT) AS is_share, CAST(1 AS BIGINT) AS sums_to_one FROM ({FEATURES_SQL})",
)
def impurity_importance(spark, sf_dir):
    shares = m.impurity_importance(spark, _storm(spark, sf_dir)[0], STORM_FEATURES)
    total = shares.agg(F.sum("importance")).scalar()
    return shares.select("feature", _flag(F.col("importance").between(0.0, 1.0), "is_share"), _flag(F.abs(total - 1) < 1e-9, "sums_to_one"))


@query(
    "latest_prediction",
    f"""SELECT series_id, max(time_tag) AS time_tag, {R('arg_max("Kp", time_tag)')} AS "Kp", CAST(1 AS BIGINT) AS same_as_batch
    FROM ship_split GROUP BY 1""",
)
def latest_prediction(spark, sf_dir):
    """Newest row of every series, all of them held out in training."""
    model, test = _storm(spark, sf_dir)
    latest = m.score_latest(model, _frame(spark, sf_dir), "series_id", "time_tag", 0.0, 9.0)
    batch = test.select("series_id", "time_tag", F.greatest(F.lit(0.0), F.least(F.lit(9.0), F.col("Kp_pred"))).alias("batch"))
    both = latest.join(batch, ["series_id", "time_tag"], "left")
    return both.select("series_id", "time_tag", r("Kp").alias("Kp"), _flag(F.abs(F.col("prediction") - F.col("batch")) < 1e-9, "same_as_batch"))


@query(
    "model_reuse",
    """SELECT series_id, CAST(1 AS BIGINT) AS reused, CAST(1 AS BIGINT) AS same FROM ship_split GROUP BY 1""",
)
def model_reuse(spark, sf_dir):
    """The stored setup again: the model is loaded and predicts the same."""
    model, _ = _storm(spark, sf_dir)

    def never():
        raise AssertionError("the setup has been trained")

    loaded, reused = _stored(spark, "storm", sf_dir, STORM, never)
    newest = windows.last_row(_frame(spark, sf_dir), "series_id", "time_tag")
    one = m.predict(model, newest, "one")
    both = m.predict(loaded, one, "two")
    return both.select("series_id", _flag(F.lit(reused), "reused"), _flag(F.abs(F.col("one") - F.col("two")) < 1e-12, "same"))


def _trajectories(spark, sf_dir, steps: int):
    """Ensemble paths from the events: one draw per user and scenario, all steps present."""
    ev = events(spark, sf_dir).select(
        "series_id", scenario_name(), F.col("user_id").alias("draw"),
        F.floor(F.hour("time_tag") / F.lit(24 // steps)).alias("step"), "value", k_of().alias("k"),
    )
    keys = ["series_id", "scenario", "draw"]
    seen = ev.groupBy(*keys, "step").agg(
        (F.lit(300.0) + F.avg("value")).alias("speed"),
        F.count("value").cast("double").alias("density"),
        (F.avg("value") / 10 - 5).alias("by_gsm"),
        (F.avg("k") / 5 - 10).alias("bz_gsm"),
    )
    members = seen.select(*keys).distinct()
    axis = members.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    full = axis.join(seen, [*keys, "step"], "left")
    full = windows.ffill(full, ["speed", "density", "by_gsm", "bz_gsm"], keys, "step")
    full = full.na.fill({"speed": 400.0, "density": 5.0, "by_gsm": 0.0, "bz_gsm": 0.0})
    start = F.lit("2024-01-30 21:00:00").cast("timestamp_ntz")
    times = time_axis(start, "3 hours", steps)
    return full.withColumns(
        {"bt": F.abs("bz_gsm") + 2.0, "time_tag": F.element_at(times, (F.col("step") + 1).cast("int"))}
    )


DRAW = ["series_id", "scenario", "draw"]


def _ensemble(spark, sf_dir):
    """Predictions of all draws, and what each step knew."""

    def make():
        model, _ = _storm(spark, sf_dir)
        history = storm_frames.bucket_means(hourly(spark, sf_dir), "series_id", "time_tag", "kp").select("series_id", "time_tag", "Kp")
        observed = kp(spark, sf_dir)
        draws = written(_trajectories(spark, sf_dir, STORM.steps), "draws")
        made = storm_forecast.forecast_storms(
            model, draws, observed, history, "series_id", STORM.steps, ["scenario", "draw"]
        )
        inputs = storm_forecast.step_inputs(draws, history, "series_id", ["scenario", "draw"])
        return written(made, "ensemble"), written(inputs, "ensemble-inputs"), observed

    return _once(spark, "ensemble", sf_dir, make)


def _one_flat_transform(model, scored, inputs, seeds, keys, series, seed_rows, default, value, features, low, high):
    """Flag per step: it equals the model on lags taken from seed and earlier predictions."""
    from seriesloom.operators.recursive import attach_seed

    paths = scored.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", value))), lambda x: x[value]).alias("_made"))
    paths = attach_seed(paths, seeds, series, seed_rows, default)
    known = inputs.join(paths, keys).withColumn("_past", F.concat("seed", F.slice("_made", F.lit(1), F.col("step").cast("int"))))
    step = F.struct(*[c for c in inputs.columns if c not in keys])
    flat = m.predict(model, known.withColumn("_step", step).withColumns(features(F.col("_past"), F.col("_step"))), low=low, high=high)
    again = flat.select(*keys, "step", F.col("prediction").alias("_again"))
    both = scored.join(again, [*keys, "step"], "left")
    return both.withColumn("_same", F.abs(F.col(value) - F.col("_again")) < 1e-9)


@query(
    "recursive_storm_forecast",
    """SELECT series_id, scenario, draw, CAST(step AS BIGINT) AS step, TIMESTAMP '2024-01-30 21:00:00' + to_hours(CAST(3 * step + 3 AS INTEGER)) AS time_tag,
    CAST(1 AS BIGINT) AS in_range, CAST(1 AS BIGINT) AS same_as_flat FROM (SELECT *, unnest(range(24)) AS step FROM ensemble_draws)""",
)
def recursive_storm_forecast(spark, sf_dir):
    """Every step of every draw, against one flat application of the model."""
    from seriesloom.operators.recursive import seed_array

    scored, inputs, observed = _ensemble(spark, sf_dir)
    seeds = seed_array(observed, "series_id", "time_tag", "Kp", 3)
    checked = _one_flat_transform(
        _storm(spark, sf_dir)[0], scored, inputs, seeds, DRAW, "series_id", 3, 2.0, "kp", storm_forecast.storm_features, 0.0, 9.0
    )
    return checked.select(*DRAW, n("step").alias("step"), "time_tag", _flag(F.col("kp").between(0.0, 9.0), "in_range"), _flag(F.col("_same"), "same_as_flat"))


@query(
    "storm_forecast_probabilities",
    """SELECT series_id, CAST(step AS BIGINT) AS step, CAST(1 AS BIGINT) AS is_probability
    FROM (SELECT DISTINCT series_id, unnest(range(24)) AS step FROM ensemble_draws)""",
)
def storm_forecast_probabilities(spark, sf_dir):
    out = exceedance_by_step(_ensemble(spark, sf_dir)[0], "kp", STORM.weights, 2.0, "series_id")
    return out.select("series_id", n("step").alias("step"), _flag(F.col("probability").between(0.0, 1.0 + 1e-12), "is_probability"))


@query(
    "seasonal_model_scores",
    f"""SELECT CAST(count(*) AS BIGINT) AS test_months, {R('avg(abs(y - base))')} AS baseline_mae, CAST(1 AS BIGINT) AS scored
    FROM month_split JOIN (SELECT series_id, avg(y) AS base FROM month_split WHERE is_train GROUP BY 1) USING (series_id) WHERE NOT is_train""",
)
def seasonal_model_scores(spark, sf_dir):
    """The monthly values are noise, so the model need only stay near the baseline."""
    scores = seasonal.seasonal_scores(_seasonal(spark, sf_dir)[2])
    near = (F.col("mae") > 0) & (F.col("mae") < 1.5 * F.col("baseline_mae"))
    return scores.select(n("test_months").alias("test_months"), r("baseline_mae").alias("baseline_mae"), _flag(near, "scored"))


def _months(spark, sf_dir):
    monthly, model, _ = _seasonal(spark, sf_dir)
    return _once(spark, "months", sf_dir, lambda: written(seasonal.forecast_months(model, monthly, "series_id", SEASONAL), "months"))


@query(
    "recursive_seasonal_forecast",
    """SELECT series_id, CAST(step AS BIGINT) AS step, time_tag, CASE WHEN months >= 36 THEN 'ok' ELSE 'too few months' END AS status,
    CAST(months >= 36 AS BIGINT) AS same_as_flat FROM months_ahead""",
)
def recursive_seasonal_forecast(spark, sf_dir):
    from seriesloom.functions.domain import fourier_terms
    from seriesloom.functions.timeaxis import month_index
    from seriesloom.operators.recursive import seed_array

    monthly, model, _ = _seasonal(spark, sf_dir)
    made = _months(spark, sf_dir)
    known = made.where("status = 'ok'")
    inputs = known.select("series_id", "step", "time_tag").withColumns(fourier_terms(month_index("time_tag"), SEASONAL.period_months))
    seeds = seed_array(monthly, "series_id", "time_tag", "ssn", seasonal.SEED_MONTHS)
    checked = _one_flat_transform(
        model, known, inputs, seeds, ["series_id"], "series_id", seasonal.SEED_MONTHS, 0.0, "ssn", seasonal.scoring_features, 0.0, None
    )
    both = made.join(checked.select("series_id", "step", "_same"), ["series_id", "step"], "left")
    return both.select("series_id", n("step").alias("step"), "time_tag", "status", _flag(F.col("_same"), "same_as_flat"))


@query(
    "seasonal_scenario_weights",
    """SELECT series_id, scenario, CAST(1 AS BIGINT) AS from_modifier, CAST(1 AS BIGINT) AS sums_to_one
    FROM (SELECT DISTINCT series_id FROM monthly_by_nation), (SELECT unnest(['Quiet', 'Moderate', 'Active']) AS scenario)""",
)
def seasonal_scenario_weights(spark, sf_dir):
    """Weights of every series, with the cycle's phase over observed and forecast months."""
    monthly = _seasonal(spark, sf_dir)[0]
    phase = seasonal.cycle_phase(monthly, _months(spark, sf_dir), "series_id", SEASONAL)
    weights = seasonal.recommended_weights(phase, "series_id")
    expected = adjusted_weights("storm_rate_modifier", STORM.weights)
    by_name = F.coalesce(*[F.when(F.col("scenario") == k, w) for k, w in expected.items()])
    total = weights.groupBy("series_id").agg(F.sum("weight").alias("total"))
    both = weights.join(phase.select("series_id", "storm_rate_modifier"), "series_id").join(total, "series_id")
    modifier = F.col("storm_rate_modifier").between(0.2, 2.0)
    return both.select(
        "series_id", "scenario", _flag(modifier & (F.abs(F.col("weight") - by_name) < 1e-9), "from_modifier"),
        _flag(F.abs(F.col("total") - 1) < 0.0021, "sums_to_one"),
    )


HOURLY_FRAME = """SELECT series_id, time_tag FROM (SELECT series_id, time_tag, lag(k, 216) OVER (PARTITION BY series_id ORDER BY time_tag) AS old FROM (
      SELECT series_id, time_bucket(INTERVAL 3 HOUR, time_tag) AS time_tag, avg(kp) AS k FROM hourly GROUP BY 1, 2)) WHERE old IS NOT NULL"""


def storm_documents(spark, sf_dir) -> DataFrame:
    """The whole flow: feeds and archive to one document per series."""
    feeds = {f.__name__: written(f(spark, sf_dir), f.__name__) for f in (plasma, mag, kp)}
    archive = written(ship_archive(spark, sf_dir).unionByName(hourly(spark, sf_dir)), "archive")
    draws = written(_trajectories(spark, sf_dir, STORM.steps), "draws")
    inputs = ("speed", "density", "by_gsm", "bz_gsm", "bt")
    paths = draws.groupBy("series_id", "scenario", "step", "time_tag").agg(*[F.avg(c).alias(c) for c in inputs])
    return reports.storm_report(
        feeds["plasma"], feeds["mag"], feeds["kp"], archive, paths, draws,
        "series_id", STORM, {"live": "events", "archive": "lineitem and events"}, now=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"),
    )


def seasonal_documents(spark, sf_dir) -> DataFrame:
    """The monthly flow: one document per nation."""
    return reports.seasonal_report(monthly_by_nation(spark, sf_dir), "series_id", SEASONAL, "orders", STORM)


def _live_sql(feed: str, more: str = "''") -> str:
    """Rows and check results of a live feed's series; observed values times 3600, so that hours become whole seconds."""
    age = "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(time_tag))) / 1000000"
    return f"""(SELECT series_id, count(*) AS c, '{feed}:not_empty:ok:' || count(*) * 3600 || ',{feed}:fresh:' ||
      CASE WHEN {age} <= 21600 THEN 'ok' ELSE 'warning' END || ':' || CAST(round({age}) AS BIGINT) || {more} AS a FROM {feed} GROUP BY 1)"""


SPEEDS = """',plasma:speed_min:' || CASE WHEN min(speed) < 100 THEN 'warning' ELSE 'ok' END || ':' || coalesce(CAST(CAST(round(min(speed) * 3600) AS BIGINT) AS VARCHAR), '')
      || ',plasma:speed_max:' || CASE WHEN max(speed) > 2000 THEN 'warning' ELSE 'ok' END || ':' || coalesce(CAST(CAST(round(max(speed) * 3600) AS BIGINT) AS VARCHAR), '')"""


@query(
    "storm_report",
    f"""SELECT series_id, coalesce(p.c, 0) AS plasma_rows, coalesce(g.c, 0) AS mag_rows, coalesce(k.c, 0) AS kp_rows, f.c AS archive_rows,
    CAST(f.c - greatest(1, least(floor(0.75 * f.c), f.c - 1)) AS BIGINT) AS test_rows, CAST(CASE WHEN series_id[1] = 'S' THEN 24 ELSE 0 END AS BIGINT) AS forecast_rows,
    CAST(1 AS BIGINT) AS in_range,
    concat_ws(',', coalesce(p.a, 'plasma:not_empty:error:0'), coalesce(g.a, 'mag:not_empty:error:0'), coalesce(k.a, 'kp:not_empty:error:0'),
      'archive:min_rows:' || CASE WHEN f.c >= 32 THEN 'ok' ELSE 'error' END || ':' || f.c * 3600) AS audit
    FROM (SELECT series_id, count(*) AS c FROM (SELECT series_id, time_tag FROM ship_frame UNION ALL {HOURLY_FRAME}) GROUP BY 1) f
    LEFT JOIN {_live_sql('plasma', SPEEDS)} p USING (series_id)
    LEFT JOIN {_live_sql('mag')} g USING (series_id)
    LEFT JOIN {_live_sql('kp')} k USING (series_id)""",
)
def storm_report(spark, sf_dir):
    """Counts, audit and ranges of the documents; the archive's level is left to the tests."""
    out = storm_documents(spark, sf_dir)
    said = F.filter("audit", lambda x: ~x["check"].startswith("Kp_"))
    value = lambda x: F.coalesce(F.round(x["observed"] * 3600).cast("long").cast("string"), F.lit(""))
    audit = F.array_join(F.transform(said, lambda x: F.concat_ws(":", x["feed"], x["check"], x["status"], value(x))), ",")
    steps = F.when(F.col("forecast").isNull(), 0).otherwise(F.size("forecast.times"))
    counts = ("plasma_rows", "mag_rows", "kp_rows", "archive_rows")
    return out.select(
        "series_id", *[n(f"counts.{c}").alias(c) for c in counts], n("metrics.test_count").alias("test_rows"),
        n(steps).alias("forecast_rows"), _flag(F.col("latest.predicted_kp").between(0.0, 9.0), "in_range"), audit.alias("audit"),
    )


@query(
    "seasonal_report",
    """SELECT series_id, count(*) AS data_months, coalesce(any_value(t.c), 0) AS test_months, CAST(12 AS BIGINT) AS months_ahead, CAST(1 AS BIGINT) AS has_phase
    FROM monthly_by_nation LEFT JOIN (SELECT series_id, count(*) AS c FROM month_split WHERE NOT is_train GROUP BY 1) t USING (series_id) GROUP BY 1""",
)
def seasonal_report(spark, sf_dir):
    """Counts and ranges of the documents."""
    out = seasonal_documents(spark, sf_dir)
    return out.select(
        "series_id", n("data_months").alias("data_months"), n(F.coalesce("metrics.test_months", F.lit(0))).alias("test_months"),
        n(F.size("forecast.times")).alias("months_ahead"),
        _flag(F.col("cycle_phase.ssn_normalized").between(0.0, 1.0) & F.col("integration.storm_rate_modifier").between(0.2, 2.0), "has_phase"),
    )
