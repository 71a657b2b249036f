import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.config import STORM_FEATURES, SeasonalConfig, StormConfig, TreeSettings
from seriesloom.operators import model as m
from seriesloom.operators import recursive
from seriesloom.plans import seasonal, storm_forecast, storm_frames
from tests.helpers import at, values

SMALL = TreeSettings(trees=6, depth=2)


class Linear:
    """Stands in for a fitted model: a sum of weighted columns."""

    def __init__(self, weights, constant=0.0):
        self.weights, self.constant = weights, constant

    def transform(self, df):
        total = F.lit(self.constant)
        for c, w in self.weights.items():
            total = total + F.col(c) * F.lit(w)
        return df.withColumn("prediction", total)


def test_recursion_against_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", j, float(rng.normal())) for i in range(40) for j in range(10)]
    steps = spark.createDataFrame(rows, "k string, step int, x double")
    arrays = recursive.step_arrays(steps, "k", "step", ["x"])
    history = spark.createDataFrame([(f"s{i}", at(h), float(i + h)) for i in range(0, 40, 2) for h in range(i % 5)], "k string, t timestamp_ntz, v double")
    seeds = recursive.seed_array(history, "k", "t", "v", 3)
    ready = recursive.attach_seed(arrays, seeds, "k", 3, 2.0)

    def features(past, step):
        return {"a": F.element_at(past, -1), "b": F.element_at(past, -3), "x": step["x"]}

    weights = {"a": 0.6, "b": 0.5, "x": 1.0}
    out = recursive.recursive_score(Linear(weights, 0.1), ready, "k", 10, features, "v", low=0.0, high=9.0, carry=["x"])
    got = {(r.k, r.step): r for r in out.collect()}
    assert len(got) == 400
    for i in range(40):
        seen = [float(i + h) for h in range(i % 5)][-3:] if i % 2 == 0 else []
        past = [2.0] * (3 - len(seen)) + seen
        for j in range(10):
            x = rows[i * 10 + j][2]
            past.append(float(np.clip(0.1 + 0.6 * past[-1] + 0.5 * past[-3] + x, 0, 9)))
            assert got[(f"s{i}", j)].v == pytest.approx(past[-1]) and got[(f"s{i}", j)].x == x


def storm_table(spark, n=300, keys=("a", "b")):
    rng = np.random.default_rng(7)
    rows = []
    for k in keys:
        for i in range(n):
            f = {c: float(rng.normal()) for c in STORM_FEATURES}
            rows.append((k, at(3 * i), *f.values(), 3.0 + f["kp_lag_3h"] + 0.5 * f["vbs"]))
    schema = "k string, time_tag timestamp_ntz, " + ", ".join(f"{c} double" for c in STORM_FEATURES) + ", Kp double"
    return spark.createDataFrame(rows, schema).repartition(4, "k").cache()


def test_storm_model_beats_its_baselines_and_repeats(spark):
    frame = storm_table(spark)
    config = StormConfig(trees=TreeSettings(trees=20))
    _, test = storm_forecast.train_storm(frame, "k", config)
    first = storm_forecast.storm_scores(test).first()
    assert first.test_count == 150
    assert first.mae < first.baseline_mae and first.r2 > 0.5 and first.skill_ratio < 1
    _, again = storm_forecast.train_storm(frame, "k", config)
    assert storm_forecast.storm_scores(again).first().mae == pytest.approx(first.mae)


def test_missing_feature_is_named(spark):
    with pytest.raises(ValueError, match="vbs"):
        m.fit(storm_table(spark).drop("vbs"), STORM_FEATURES, "Kp", SMALL)


def test_cross_validation(spark):
    scores = m.cross_validate(storm_table(spark), STORM_FEATURES, "Kp", SMALL, "k", "time_tag")
    rows = scores.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3, 4]
    assert all(r.rows == 100 and r.mae > 0 and 0 <= r.csi <= 1 for r in rows)
    assert m.fold_summary(scores).first().folds == 5


def test_importance(spark):
    frame = storm_table(spark)
    model = m.fit(frame, STORM_FEATURES, "Kp", SMALL)
    perm = m.permutation_importance(model, frame, STORM_FEATURES, "Kp", ["k", "time_tag"], repeats=3)
    ranked = [r.feature for r in perm.orderBy(F.desc("importance")).collect()]
    assert len(ranked) == 14 and ranked[:2] == ["kp_lag_3h", "vbs"]
    flat = perm.where("feature = 'density_mean'").first()
    assert abs(flat.importance) < 0.05
    impurity = m.impurity_importance(spark, model, STORM_FEATURES)
    assert impurity.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_permutation_only_moves_values(spark):
    """With a model that reads one column, shuffling another changes nothing."""
    df = spark.range(500).select(F.col("id").alias("i"), F.sin("id").alias("x"), F.cos("id").alias("z"), F.sin("id").alias("y"))
    out = m.permutation_importance(Linear({"x": 1.0}), df, ["x", "z"], "y", ["i"], repeats=2)
    got = {r.feature: r for r in out.collect()}
    assert got["z"].importance == pytest.approx(0.0)
    assert got["x"].importance == pytest.approx(2.0, abs=0.4)


def test_model_reuse(spark, folder):
    frame = storm_table(spark)
    calls = []

    def train():
        calls.append(1)
        return m.fit(frame, STORM_FEATURES, "Kp", SMALL)

    a = m.settings_key(start_year=2020, years=5, train_fraction=0.75)
    b = m.settings_key(start_year=2020, years=8, train_fraction=0.75)
    one, reused = m.fit_or_load(spark, folder, a, train)
    assert not reused
    two, reused = m.fit_or_load(spark, folder, a, train)
    assert reused and len(calls) == 1
    m.fit_or_load(spark, folder, b, train)
    assert len(calls) == 2 and a != b
    p, q = (values(m.score_latest(x, frame, "k", "time_tag", 0, 9), "k", "prediction") for x in (one, two))
    assert p == q and len(p) == 2


def test_storm_forecast_uses_history_and_seed(spark):
    scen = spark.createDataFrame(
        [("a", s, i, at(3 * i), 400.0, 5.0, 1.0, bz, 6.0) for s in ("Quiet", "Active") for i, bz in enumerate((-1.0, 2.0, -4.0, 3.0, 3.0, 3.0))],
        "k string, scenario string, step int, time_tag timestamp_ntz, speed double, density double, by_gsm double, bz_gsm double, bt double",
    )
    history = spark.createDataFrame([("a", at(3 * i, days=-27), 1.0 + i) for i in range(2)], "k string, time_tag timestamp_ntz, Kp double")
    inputs = storm_forecast.step_inputs(scen, history, "k")
    quiet = inputs.where("scenario = 'Quiet'")
    assert values(quiet, "bz_min", "kp_lag_27d", order="step") == [(-1.0, 1.0), (-1.0, 2.0), (-4.0, 2.0), (-4.0, 2.0), (-4.0, 2.0), (3.0, 2.0)]
    seen = spark.createDataFrame([("a", at(-3), 4.0)], "k string, time_tag timestamp_ntz, Kp double")
    model = Linear({"kp_lag_3h": 1.0, "kp_lag_9h": 1.0})
    out = storm_forecast.forecast_storms(model, scen, seen, history, "k", 6)
    kp = [v for (v,) in values(out.where("scenario = 'Active'"), "kp", order="step")]
    assert kp == [6.0, 8.0, 9.0, 9.0, 9.0, 9.0]
    assert values(out.where("scenario = 'Active' and step = 2"), "time_tag") == [(at(6),)]


def monthly(spark, keys=("a", "b"), months=140):
    rows = []
    for k in keys:
        for i in range(months):
            y, mth = 2010 + i // 12, i % 12 + 1
            rows.append((k, y, mth, 60 + 50 * float(np.sin(2 * np.pi * i / 132))))
    df = spark.createDataFrame(rows, "k string, y int, m int, ssn double")
    t = F.make_timestamp_ntz(F.col("y"), F.col("m"), F.lit(15), F.lit(0), F.lit(0), F.lit(0))
    return df.select("k", t.alias("time_tag"), "ssn").cache()


def test_seasonal_flow(spark):
    data = monthly(spark, months=280)
    config = SeasonalConfig(trees=TreeSettings(trees=10, rate=0.3), months_ahead=8, cycle_start="2019-01-01")
    model, test = seasonal.train_seasonal(data, "k", config)
    scores = seasonal.seasonal_scores(test, "k").collect()
    assert all(s.test_months == 37 and s.mae < s.baseline_mae for s in scores)
    ahead = seasonal.forecast_months(model, data, "k", config)
    assert ahead.count() == 16
    times = [t for (t,) in values(ahead.where("k = 'a'"), "time_tag", order="step")]
    assert (times[0].year, times[0].month, times[0].day) == (2033, 5, 15)
    phase = seasonal.cycle_phase(data, ahead, "k", config)
    now = seasonal.cycle_phase(data, ahead, "k", config, at_last_observed=True)
    a, b = phase.first(), now.first()
    assert 0 <= a.ssn_normalized <= 1 and 0.2 <= a.storm_rate_modifier <= 2.0
    assert a.current_smooth_ssn != b.current_smooth_ssn
    w = seasonal.recommended_weights(phase, "k")
    sums = w.groupBy("k").agg(F.sum("weight").alias("s")).collect()
    assert all(s.s == pytest.approx(1.0, abs=0.002) for s in sums)


def test_cycle_phase_rows(spark):
    """The level is the centred mean of the last row, six months ahead of the observations."""
    rows = [("a", i, float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "k string, i int, ssn double")
    t = F.add_months(F.lit("2020-01-15").cast("date"), F.col("i")).cast("timestamp_ntz").alias("time_tag")
    seen = df.where("i < 18").select("k", t, "ssn")
    ahead = df.where("i >= 18").select("k", (F.col("i") - 18).alias("step"), t, "ssn")
    out = seasonal.cycle_phase(seen, ahead, "k", SeasonalConfig()).first()
    assert out.current_smooth_ssn == pytest.approx(np.mean(range(17, 24)))
    assert out.cycle_min_ssn == 3.0 and out.ssn_normalized == 1.0
    assert out.solar_activity_tier == "Minimum" and out.f107_proxy == pytest.approx(73.4)


def test_seasonal_features_align(spark):
    out = seasonal.seasonal_features(monthly(spark, ("a",), 50), "k")
    assert out.count() == 14
    first = out.orderBy("time_tag").first()
    assert first.time_tag.year == 2013 and first.ssn_lag_36m == 60.0
    assert out.where("ssn_next is null").count() == 1


def test_live_frame_needs_both_instruments(spark):
    p = spark.createDataFrame([("a", at(0), 400.0, 5.0), ("a", at(1), 420.0, None), ("a", at(4), 500.0, 4.0)], "k string, time_tag timestamp_ntz, speed double, density double")
    g = spark.createDataFrame([("a", at(h), 1.0, -2.0 - h, 5.0) for h in (0, 1, 2, 4)], "k string, time_tag timestamp_ntz, by_gsm double, bz_gsm double, bt double")
    out = storm_frames.live_frame(p, g, None, None, "k")
    assert out.columns == ["k", "time_tag", *STORM_FEATURES]
    assert values(out, "time_tag", "speed_mean", "bz_min", "kp_lag_3h") == [(at(0), 400.0, -2.0, 2.0), (at(3), 500.0, -6.0, 2.0)]
    kp = spark.createDataFrame([("a", at(0), 3.0), ("a", at(0.5), 4.0)], "k string, time_tag timestamp_ntz, Kp double")
    past = spark.createDataFrame([("a", at(3, days=-27), 6.0)], "k string, time_tag timestamp_ntz, Kp double")
    out = storm_frames.live_frame(p, g, kp, past, "k")
    assert values(out, "kp_lag_3h", "kp_lag_6h", "kp_lag_27d", order="time_tag") == [(2.0, 2.0, 6.0), (3.5, 2.0, 6.0)]


def test_no_training_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        m.fit(storm_table(spark).where("false"), STORM_FEATURES, "Kp", SMALL)


def test_reports(spark, monkeypatch):
    """On the middle tables: the smallest have no live series long enough for a 27-day lag."""
    import json
    import os
    from dataclasses import replace

    from workload import modelling

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    few = replace(modelling.STORM, trees=replace(modelling.STORM.trees, trees=10), steps=8)
    monkeypatch.setattr(modelling, "STORM", few)
    monkeypatch.setattr(modelling, "SEASONAL", replace(modelling.SEASONAL, trees=few.trees))
    as_text = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]
    storms = as_text(modelling.storm_documents(spark, data))
    assert {d["series_id"][0] for d in storms} == {"N", "S"}
    checks = {"plasma": ["not_empty", "fresh", "speed_min", "speed_max"], "mag": ["not_empty", "fresh"], "kp": ["not_empty", "fresh"]}
    for doc in storms:
        assert doc["metrics"]["test_count"] > 0 and doc["latest"]["category"]
        audit = {(r["feed"], r["check"]): r for r in doc["audit"]}
        assert len(audit) == len(doc["audit"])
        for feed, names in checks.items():
            rows = doc["counts"][f"{feed}_rows"]
            assert [c for f, c in audit if f == feed] == (names if rows else ["not_empty"])
            assert audit[feed, "not_empty"]["observed"] == rows
            assert audit[feed, "not_empty"]["status"] == ("ok" if rows else "error")
        assert audit["archive", "min_rows"]["observed"] == doc["counts"]["archive_rows"]
        assert audit["archive", "Kp_max"]["status"] == ("ok" if audit["archive", "Kp_max"]["observed"] <= 9.5 else "warning")
        assert ("forecast" in doc) == (doc["series_id"][0] == "S")
        if "forecast" in doc:
            f = doc["forecast"]
            assert len(f["times"]) == len(f["kp_weighted"]) == len(f["storm_prob_per_window"]) == 8
            assert set(f["by_scenario"]) == {"Quiet", "Moderate", "Active"}
            assert all(0 <= v <= 9 for a in f["by_scenario"].values() for v in a)
            assert 0 <= max(f["storm_prob_per_window"]) * 100 <= doc["outlook"]["storm_prob_pct"] + 1e-9 <= 100
    months = as_text(modelling.seasonal_documents(spark, data))
    assert len(months) == 25
    for doc in months:
        assert len(doc["forecast"]["times"]) == 12
        assert sum(doc["integration"]["recommended_scenario_weights"].values()) == pytest.approx(1.0, abs=0.002)


def test_recursion_with_fitted_trees_equals_a_loop(spark):
    """Each step of ``recursive_score`` is the fitted model on the values made so far."""
    rows = [(float(i % 7), float(i % 5), float((i % 7) * 0.7 + (i % 5) * 0.2)) for i in range(300)]
    train = spark.createDataFrame(rows, "lag double, x double, y double")
    model = m.fit(train, ["lag", "x"], "y", TreeSettings(trees=8))
    inputs = [0.0, 3.0, 1.0, 4.0]
    paths = spark.createDataFrame([("a", [2.0], [(x,) for x in inputs])], "k string, seed array<double>, inputs array<struct<x: double>>")
    features = lambda past, step: {"lag": F.element_at(past, -1), "x": step["x"]}
    made = [r.v for r in recursive.recursive_score(model, paths, "k", 4, features, "v").orderBy("step").collect()]
    value, wanted = 2.0, []
    for x in inputs:
        value = m.predict(model, spark.createDataFrame([(value, x)], "lag double, x double")).first()["prediction"]
        wanted.append(value)
    assert made == pytest.approx(wanted)


def test_boosting_starts_from_the_mean(spark, folder):
    frame = storm_table(spark).withColumn("Kp", F.col("Kp") + 100.0)
    none = m.fit(frame, STORM_FEATURES, "Kp", TreeSettings(trees=0))
    mean = frame.agg(F.avg("Kp")).first()[0]
    assert {r.prediction for r in m.predict(none, frame).select("prediction").distinct().collect()} == {mean}
    model = m.fit(frame, STORM_FEATURES, "Kp", TreeSettings(trees=1, depth=1))
    assert m.predict(model, frame).agg(F.avg("prediction")).first()[0] == pytest.approx(mean, abs=0.05)
    model.save(f"{folder}/m")
    again = m.PipelineModel.load(f"{folder}/m")
    a, b = (values(m.predict(x, frame), "k", "time_tag", "prediction") for x in (model, again))
    assert a == b and m.trees_of(again).getNumTrees == 1
    assert "_above_mean" not in m.predict(model, frame).columns


def test_folds_side_by_side_equal_folds_in_turn(spark):
    frame = storm_table(spark)
    run = lambda n: m.cross_validate(frame, STORM_FEATURES, "Kp", SMALL, "k", "time_tag", at_once=n)
    one, all_ = (values(run(n), "fold", "rows", "mae", "r2", "csi") for n in (1, None))
    assert one == all_ and len(one) == 5


def test_a_cap_below_the_least_length_keeps_the_folds(spark):
    """Whether a series is long enough goes by all its rows."""
    from seriesloom.operators import splits

    df = spark.createDataFrame([(k, at(3 * i), float(i)) for k, n in (("a", 200), ("b", 150)) for i in range(n)], "k string, t timestamp_ntz, v double")
    out = splits.expanding_folds(df, 5, 3, "k", "t", max_rows=150).collect()
    assert {r.k for r in out} == {"a"} and {r.fold for r in out} == set(range(5))
    assert min(r.v for r in out) == 50.0
    status = {r.k: (r.folds, r.status) for r in splits.fold_status(df, 5, 3, "k", max_rows=150).collect()}
    assert status == {"a": (5, "ok"), "b": (0, "left out")}


def test_tasks_side_by_side(spark):
    from seriesloom.session import together

    spark.sparkContext.setLocalProperty("callSite.short", "mine")
    seen = lambda i: (i, spark.sparkContext.getLocalProperty("callSite.short"), spark.range(i).count())
    assert together(spark, [lambda i=i: seen(i) for i in range(4)], "t") == [(i, "mine", i) for i in range(4)]
    assert together(spark, [], "t") == []
    begun = []

    def fails():
        begun.append(1)
        raise KeyError("no")

    with pytest.raises(KeyError):
        together(spark, [fails] * 3, "t", at_once=1)
    assert len(begun) == 1 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    spark.sparkContext.setLocalProperty("callSite.short", None)


def test_long_horizons_are_cut(spark):
    """Cut trajectories give the same values, and no plan grows with the horizon."""
    arrays = spark.createDataFrame([("a", [1.0], [(float(i % 3),) for i in range(120)])], "k string, seed array<double>, inputs array<struct<x: double>>")
    features = lambda past, step: {"lag": F.element_at(past, -1), "x": step["x"]}
    model = Linear({"lag": 0.5, "x": 1.0}, 0.25)
    cut = recursive.recursive_score(model, arrays, "k", 120, features, "v", cut_every=20)
    wanted, value = [], 1.0
    for i in range(120):
        value = 0.25 + 0.5 * value + i % 3
        wanted.append(value)
    assert [r.v for r in cut.orderBy("step").collect()] == pytest.approx(wanted)
    whole = recursive.recursive_score(model, arrays, "k", 20, features, "v", cut_every=20)
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(cut) < 1.2 * size(whole)
