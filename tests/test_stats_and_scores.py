import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import ensemble, quality, splits, stats, verify
from seriesloom.operators.model import fold_summary
from tests.helpers import at, values


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100, 1001])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_are_exact(spark, n, accuracy):
    rng = np.random.default_rng(n)
    a = np.round(rng.lognormal(0, 2, n), 2)
    b = rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = stats.exact_quantiles(df, ["a", "b"], probs, accuracy=accuracy).collect()
    assert len(got) == 12
    for row in got:
        wanted = np.quantile(a if row.column == "a" else b, row.prob)
        assert row.quantile == pytest.approx(wanted, abs=1e-12)


def test_quantiles_of_one_heavy_value_and_a_null_group(spark):
    rows = [(None, 5.0)] * 500 + [(None, float(i)) for i in range(100)] + [("k", 1.0), ("k", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = stats.describe(df, ["v"], "g").collect()
    by = {r.g: r for r in out}
    nulls = np.array([5.0] * 500 + list(range(100)))
    assert by[None].p50 == 5.0 and by[None]["count"] == 600
    assert by[None].p75 == pytest.approx(np.quantile(nulls, 0.75))
    assert by["k"].p25 == 1.25 and by["k"].std == pytest.approx(np.std([1, 2], ddof=1))


def test_null_profile_and_peak(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(3), 7.0), ("a", at(6), 7.0), ("b", at(0), None)], "k string, t timestamp_ntz, v double")
    assert values(stats.null_profile(df, ["v"]), "column", "nulls", "rows") == [("v", 1, 4)]
    assert values(stats.peak_row(df, "v", "t", "k"), "k", "peak_time", "peak_value") == [("a", at(3), 7.0)]


def numbered(spark, n, keys=("a",)):
    return spark.createDataFrame([(k, at(3 * i), float(i)) for k in keys for i in range(n)], "k string, t timestamp_ntz, v double")


@pytest.mark.parametrize("n, fraction, low, high, cut", [(10, 0.75, 1, 1, 7), (2, 0.99, 1, 1, 1), (30, 0.85, 12, 12, 18), (3, 0.0, 1, 1, 1)])
def test_split(spark, n, fraction, low, high, cut):
    out = splits.time_split(numbered(spark, n), fraction, "k", "t", low, high, span="6 hours")
    train = [r.v for r in out.where("is_train").collect()]
    assert sorted(train) == [float(i) for i in range(cut)]


@pytest.mark.parametrize("n, rows", [(159, 0), (160, 5)])
def test_folds_need_enough_rows(spark, n, rows):
    out = splits.expanding_folds(numbered(spark, n), 5, 3, "k", "t")
    assert out.select("fold").distinct().count() == rows


@pytest.mark.parametrize("n, limit", [(160, None), (200, None), (500, 250)])
def test_folds_expand_with_a_gap(spark, n, limit):
    out = splits.expanding_folds(numbered(spark, n, ("a", "b")), 5, 3, "k", "t", max_rows=limit, min_rows=100, span="1 day").collect()
    m = min(n, limit or n)
    size, skipped = m // 6, n - m
    for k in ("a", "b"):
        for fold in range(5):
            first = m - (5 - fold) * size
            test = sorted(int(r.v) - skipped for r in out if r.k == k and r.fold == fold and not r.is_train)
            train = sorted(int(r.v) - skipped for r in out if r.k == k and r.fold == fold and r.is_train)
            assert test == list(range(first, first + size))
            assert train == list(range(0, first - 3))


def test_scores(spark):
    rng = np.random.default_rng(0)
    y, p = rng.uniform(0, 9, 200), rng.uniform(0, 9, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    got = verify.regression_scores(df, "y", "p").first()
    assert got.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert got.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    c = verify.contingency(df, "y", "p", 5.0).first()
    tp, fp, fn = ((y >= 5) & (p >= 5)).sum(), ((y < 5) & (p >= 5)).sum(), ((y >= 5) & (p < 5)).sum()
    assert (c.tp, c.fp, c.fn) == (tp, fp, fn)
    assert c.csi == pytest.approx(tp / (tp + fp + fn))
    assert c.pod == pytest.approx(tp / (tp + fn)) and c.far == pytest.approx(fp / (tp + fp))


def test_scores_without_events_or_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    c = verify.contingency(df, "y", "p", 5.0).first()
    assert c.csi == 0.0 and c.pod is None and c.far is None
    assert verify.regression_scores(df, "y", "p").first().r2 is None


def test_baseline_and_skill(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, True), (5.0, False)], "y double, is_train boolean")
    assert verify.with_train_mean(df, "y", "b").first().b == 2.0
    s = spark.createDataFrame([(0.5, 1.0, 0.0)], "mae double, persistence_mae double, baseline_mae double")
    out = verify.skill(s).first()
    assert out.skill_ratio == 0.5 and out.improvement_pct is None


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_histogram(spark, keys):
    v = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    out = {r.bin: r.rows for r in verify.histogram(df, "v", 30, keys).collect()}
    counts, _ = np.histogram(v, 30)
    assert [out.get(i, 0) for i in range(30)] == list(counts)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3, "k string, v double")
    out = verify.histogram(df, "v", 4, "k").collect()
    assert [(r.bin, r.rows, r.left_edge) for r in out] == [(2, 3, 2.0)]


@pytest.mark.parametrize("horizon", [1, 2, 4])
@pytest.mark.parametrize("span", [None, "1 day"])
def test_diebold_mariano(spark, horizon, span):
    rng = np.random.default_rng(3)
    y, a, b = rng.normal(size=(3, 120))
    df = spark.createDataFrame([("s", at(3 * i), *map(float, x)) for i, x in enumerate(zip(y, a, b))], "k string, t timestamp_ntz, y double, a double, b double")
    d = np.abs(y - a) - np.abs(y - b)
    m = d.mean()
    var = np.mean((d - m) ** 2) + 2 * sum(np.sum((d[k:] - m) * (d[:-k] - m)) / len(d) for k in range(1, horizon))
    got = verify.diebold_mariano(df, "y", "a", "b", "k", "t", horizon, span).first()
    assert got.dm_statistic == pytest.approx(m / np.sqrt(var / len(d)), rel=1e-6)


def test_reliability_includes_one(spark):
    df = spark.createDataFrame([(0.0, 0), (0.05, 1), (1.0, 1)], "p double, o int")
    out = {r.bin: (r.rows, r.observed_frequency) for r in verify.reliability(df, "p", F.col("o") == 1).collect()}
    assert out == {0: (2, 0.5), 9: (1, 1.0)}


def draws(spark):
    rng = np.random.default_rng(5)
    rows = [(s, d, i, float(rng.uniform(0, 7))) for s in ("Quiet", "Moderate", "Active", "Other") for d in range(20) for i in range(6)]
    return rows, spark.createDataFrame(rows, "scenario string, draw int, step int, kp double")


WEIGHTS = {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.6}


def test_exceedance(spark):
    rows, df = draws(spark)
    total = sum(WEIGHTS.values())
    arrays = {s: np.array([r[3] for r in rows if r[0] == s]).reshape(20, 6) for s in WEIGHTS}
    by_step = sum(w / total * (arrays[s] >= 5).mean(axis=0) for s, w in WEIGHTS.items())
    any_step = sum(w / total * (arrays[s].max(axis=1) >= 5).mean() for s, w in WEIGHTS.items())
    out = ensemble.LEAVE_OUT
    got = {r.step: r.probability for r in ensemble.exceedance_by_step(df, "kp", WEIGHTS, unweighted=out).collect()}
    whole = ensemble.exceedance_any_step(df, "kp", WEIGHTS, unweighted=out).first()
    assert [got[i] for i in range(6)] == pytest.approx(list(by_step))
    assert whole.probability == pytest.approx(any_step) and whole.draws == 20
    assert all(0 <= p <= whole.probability <= 1 for p in got.values())


def test_weight_table_equals_mapping(spark):
    _, df = draws(spark)
    table = spark.createDataFrame(list(WEIGHTS.items()), "scenario string, weight double")
    a = ensemble.weighted_by_step(df, "kp", WEIGHTS, ["draw", "step"], unweighted=ensemble.LEAVE_OUT)
    b = ensemble.weighted_by_step(df, "kp", table, ["draw", "step"], unweighted=ensemble.LEAVE_OUT)
    x, y = (values(d.select("draw", "step", F.round("kp", 9).alias("kp")), "draw", "step", "kp") for d in (a, b))
    assert x == y


@pytest.mark.parametrize("run", [ensemble.exceedance_by_step, ensemble.exceedance_any_step])
def test_exceedance_without_a_weight_fails_unless_told(spark, run):
    _, df = draws(spark)
    with pytest.raises(Exception, match="no weight for scenario Other"):
        run(df, "kp", WEIGHTS).collect()
    with pytest.raises(ValueError, match="leave out"):
        run(df, "kp", WEIGHTS, unweighted="drop")
    kept = df.where("scenario <> 'Other'")
    assert values(run(df, "kp", WEIGHTS, unweighted=ensemble.LEAVE_OUT), "probability") == values(run(kept, "kp", WEIGHTS), "probability")


def test_scenario_summary(spark):
    df = spark.createDataFrame([("q", at(0), 4.9), ("q", at(3), 5.0), ("q", at(6), 7.0), ("n", at(0), 1.0)], "scenario string, t timestamp_ntz, kp double")
    out = {r.scenario: r for r in ensemble.scenario_summary(df, "kp", "t").collect()}
    assert (out["q"].storm_rows, out["q"].severe_rows, out["q"].first_storm) == (2, 1, at(3))
    assert out["n"].first_storm is None


def test_probability_error(spark):
    row = spark.range(1).select(
        verify.probability_error(F.lit(0.2), F.lit(500)).alias("e"),
        verify.is_low_probability(F.lit(0.01)).alias("low"),
        verify.is_low_probability(F.lit(0.0)).alias("zero"),
    ).first()
    assert row.e == pytest.approx(0.0178885, abs=1e-6) and row.low and not row.zero


def test_fold_summary(spark):
    df = spark.createDataFrame([(0.4,), (0.6,)], "mae double")
    row = fold_summary(df, ["mae"]).first()
    assert (row.mae_mean, row.mae_std) == pytest.approx((0.5, 0.1))
    assert row.mae_ci95 == pytest.approx(1.96 * 0.1 / 2**0.5)


def test_audit(spark):
    df = spark.createDataFrame([(at(0), 50.0, None), (at(3), 400.0, None)], "t timestamp_ntz, speed double, bz double")
    now = F.lit(at(10)).cast("timestamp_ntz")
    checks = [
        quality.not_empty(), quality.min_rows(3), quality.fresh("t", now), *quality.in_range("speed", 100, 2000),
        *quality.not_all_null(["speed", "bz"]), quality.expected_events(8),
    ]
    out = {r.check: r.status for r in quality.audit(df, checks).collect()}
    assert out == {
        "not_empty": "ok", "min_rows": "error", "fresh": "warning", "speed_min": "warning", "speed_max": "ok",
        "speed_present": "ok", "bz_present": "error", "expected_events": "ok",
    }
    empty = {r.check: r.status for r in quality.audit(df.where("false"), checks).collect()}
    assert empty["not_empty"] == "error" and empty["speed_min"] == "ok"
    cols = {r.check: r.status for r in quality.column_audit(df, ["speed", "kp"]).collect()}
    assert cols == {"speed": "ok", "kp": "error"}


def test_audit_beside_counts(spark):
    """The report's audit equals separate audits of each table; a table without the series has one failing row."""
    from seriesloom.plans import reports

    now = F.lit(at(10)).cast("timestamp_ntz")
    checks = reports.storm_checks(now, "t")
    row = "s string, t timestamp_ntz, speed double, Kp double"
    tables = {
        "plasma": spark.createDataFrame([("a", at(0), 50.0, None), ("a", at(9), 2500.0, None), ("b", at(1), None, None)], row),
        "mag": spark.createDataFrame([("a", at(9), None, None)], row),
        "kp": spark.createDataFrame([], row),
        "archive": spark.createDataFrame([(s, at(i), None, i / 4) for s in "ab" for i in range(40 if s == "a" else 3)], row),
    }
    made = reports._audited(tables, checks, ["s"]).collect()
    assert sorted(r.s for r in made) == ["a", "b"]
    apart = {
        name: {(r.s, r.check): (r.status, r.observed, r.limit) for r in quality.audit(df, checks[name], "s").collect()} for name, df in tables.items()
    }
    for r in made:
        got = {(x.feed, x.check): (x.status, x.observed, x.limit) for x in r.audit}
        want = {(name, check): found for name, rows in apart.items() for (s, check), found in rows.items() if s == r.s}
        for name in tables:
            if not any(f == name for f, _ in want):
                want[name, "not_empty"] = ("error", 0.0, "> 0")
        assert got == want and len(r.audit) == len(got)
    by_series = {r.s: r for r in made}
    assert by_series["a"].counts.asDict() == {"plasma_rows": 2, "mag_rows": 1, "kp_rows": 0, "archive_rows": 40}
    assert {x.check: x.status for x in by_series["a"].audit if x.feed == "plasma"} == {
        "not_empty": "ok", "fresh": "ok", "speed_min": "warning", "speed_max": "warning",
    }
    assert {x.check: x.status for x in by_series["b"].audit if x.feed == "archive"} == {"min_rows": "error", "Kp_min": "ok", "Kp_max": "ok"}


def test_normal_tail_and_p_value(spark):
    import math

    zs = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, 3.0, 5.0, 7.0, 7.2, 9.0, 20.0]
    made = spark.createDataFrame([(z,) for z in zs], "z double").select("z", verify.normal_tail("z").alias("p")).collect()
    for r in made:
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-7, abs=1e-15)
    rng = np.random.default_rng(4)
    y, a, b = rng.normal(size=(3, 90))
    df = spark.createDataFrame([("s", at(3 * i), *map(float, x)) for i, x in enumerate(zip(y, a, b))], "k string, t timestamp_ntz, y double, a double, b double")
    got = verify.diebold_mariano(df, "y", "a", "b", "k", "t", 3, p_value=True).first()
    factor = math.sqrt((90 + 1 - 6 + 3 * 2 / 90) / 90)
    assert got.adjusted == pytest.approx(got.dm_statistic * factor)
    assert got.p_value == pytest.approx(math.erfc(abs(got.adjusted) / math.sqrt(2)), abs=1e-7)


@pytest.mark.parametrize("most", [30, 400, 1_000_000])
def test_quantiles_in_rounds(spark, monkeypatch, most):
    """Narrowed brackets give numpy's quantiles, and no window gets more rows than the bound."""
    from seriesloom.operators import stats

    rng = np.random.default_rng(8)
    tables = {
        "even": np.arange(20_000) / 7, "equal": np.full(5000, 3.0), "steps": rng.integers(0, 4, 9000).astype(float),
        "spike": np.concatenate([np.zeros(7000), rng.normal(size=7000)]), "few": np.array([1.0, 2.0, 4.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, a in tables.items() for v in a], "k string, v double")
    rounds, keep = [], stats.written
    monkeypatch.setattr(stats, "written", lambda d, label: rounds.append(keep(d, label)) or rounds[-1])
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r.k, r.prob): r.quantile for r in stats.exact_quantiles(df, ["v"], probs, "k", accuracy=1000, most=most).collect()}
    for k, a in tables.items():
        for q in probs:
            assert got[k, q] == pytest.approx(np.quantile(a, q), abs=1e-12)
    last = rounds[-1].collect()
    assert max(r[f"_in{j}"] for r in last for j in range(6)) <= most
    assert (len(rounds) > 1) == (most == 30)  # the first brackets hold up to 80 rows
    whole = stats.exact_quantiles(df, ["v"], (0.5,), (), accuracy=1000, most=most).first()
    assert whole.quantile == pytest.approx(np.median(np.concatenate(list(tables.values()))))


def test_quantiles_of_many_rows(spark):
    from seriesloom.operators import stats

    df = spark.range(10_000_000).select((F.col("id") * 7919 % 10_000_000).cast("double").alias("v"))
    got = {r.prob: r.quantile for r in stats.exact_quantiles(df, ["v"], most=1000).collect()}
    assert got == {0.25: 2499999.75, 0.5: 4999999.5, 0.75: 7499999.25}
