import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom._common import time_chunk
from seriesloom.operators import asof, resample, windows
from tests.helpers import at, values


def series(spark, hours, values_=None, key="a"):
    vs = values_ if values_ is not None else [float(i) for i in range(len(hours))]
    rows = [(key, at(h), v) for h, v in zip(hours, vs)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")


def skewed(spark):
    """One series with a third of all rows and uneven density, several small ones."""
    hot = spark.range(3000).select(
        F.lit("hot").alias("k"), (F.pow(F.col("id"), 1.5) * 7).cast("long").alias("s"), F.col("id").cast("double").alias("v")
    )
    rest = spark.range(6000).select(
        (F.col("id") % 60).cast("string").alias("k"), (F.col("id") * 331).alias("s"), F.sin("id").alias("v")
    )
    df = hot.unionByName(rest)
    return df.select("k", F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz").alias("t"), "v")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_row_numbers_equal_a_plain_window(spark):
    df = skewed(spark)
    got = windows.number_rows(df, "k", ["t"], time_chunk("t", "1 hour"), total="n")
    w = windows.over(["k"], "t")
    wanted = df.withColumns(
        {"row_no": (F.row_number().over(w) - 1).cast("long"), "n": F.count("v").over(windows.over(["k"]))}
    )
    assert same(got.select("k", "t", "row_no", "n"), wanted.select("k", "t", "row_no", "n"))


@pytest.mark.parametrize("block", [7, 100, 65_536])
def test_span_gives_the_same_lags(spark, block):
    df = skewed(spark)
    shifts = {"a": ("v", 1), "b": ("v", 50), "c": ("v", -2)}
    plain = windows.lags(df, shifts, "k", "t")
    split = windows.lags(df, shifts, "k", "t", span="2 hours", block_rows=block)
    assert same(plain, split.select(*plain.columns))


def test_span_gives_the_same_rolling(spark):
    df = skewed(spark).withColumn("v", F.col("v").cast("decimal(20,6)"))
    for centred in (False, True):
        plain = windows.rolling(df, "v", 13, "m", "k", "t", 7, centred)
        split = windows.rolling(df, "v", 13, "m", "k", "t", 7, centred, span="2 hours", block_rows=40)
        assert same(plain, split.select(*plain.columns))


def test_span_gives_the_same_fill(spark):
    df = skewed(spark).withColumn("v", F.when(F.abs("v") > 0.95, F.col("v")))
    plain = windows.ffill(df, "v", "k", "t")
    assert same(plain, windows.ffill(df, "v", "k", "t", span="30 minutes"))


def test_null_key_fails_loudly(spark):
    df = series(spark, [0, 1]).withColumn("k", F.when(F.col("v") > 0, F.col("k")))
    with pytest.raises(Exception, match="without NULL"):
        windows.number_rows(df, "k", ["t"], time_chunk("t", "1 hour")).collect()


def test_lag_counts_rows_and_lookback_counts_time(spark):
    df = series(spark, [0, 3, 9], [1.0, 2.0, 3.0])
    assert values(windows.lags(df, {"p": ("v", 1)}, "k", "t"), "v", "p") == [(1.0, None), (2.0, 1.0), (3.0, 2.0)]
    exact = resample.lookback_join(df, df, "t", "3 hours", "v", "p", "k")
    assert values(exact, "v", "p") == [(1.0, None), (2.0, 1.0), (3.0, None)]


def test_lag_fill_default(spark):
    df = series(spark, [0, 3, 6, 9], [None, 4.0, None, 6.0])
    out = windows.lags_filled(df, "v", {"a": 1, "b": 3}, "k", "t", 2.0)
    assert values(out, "a", "b", order="t") == [(2.0, 2.0), (2.0, 2.0), (4.0, 2.0), (4.0, 2.0)]


@pytest.mark.parametrize("n, known", [(6, 0), (7, 7)])
def test_centred_mean_of_short_series(spark, n, known):
    out = windows.rolling(series(spark, list(range(n))), "v", 13, "m", "k", "t", 7, centred=True)
    assert out.where("m is not null").count() == known


def test_tail_last_and_fraction(spark):
    df = series(spark, [0, 1, 2, 3, 4])
    assert values(windows.tail_rows(df, 2, "k", "t"), "v") == [(3.0,), (4.0,)]
    assert values(windows.last_row(df, "k", "t"), "v") == [(4.0,)]
    out = windows.index_fraction(df, "k", "t", "1 hour")
    assert values(out, "row_index", "row_fraction", order="t")[1] == (1, 0.25)
    assert values(windows.index_fraction(series(spark, [0]), "k", "t", "1 hour"), "row_fraction") == [(0.0,)]


def test_resample_is_left_closed(spark):
    df = series(spark, [0, 2.99, 3, 9], [1.0, 3.0, 5.0, 7.0])
    out = resample.resample(df, "t", "3 hours", [F.avg("v").alias("m"), F.min("v").alias("lo")], "k")
    assert values(out, "t", "m", "lo") == [(at(0), 2.0, 1.0), (at(3), 5.0, 5.0), (at(9), 7.0, 7.0)]
    full = resample.resample_full(df, "t", "3 hours", [F.avg("v").alias("m")], "k")
    assert values(full, "t", "m", order="t")[2] == (at(6), None)


def test_long_grid(spark):
    df = series(spark, [0, 5000])
    assert resample.grid(df, "t", "1 minute", "k").count() == 5000 * 60 + 1


def lookup(spark, fn, probes, history, **kw):
    p = spark.createDataFrame([("a", at(h)) for h in probes], "k string, p timestamp_ntz")
    h = spark.createDataFrame([("a", at(t), v) for t, v in history], "k string, t timestamp_ntz, v double")
    out = fn(p, h, "p", "t", "v", "found", "k", **kw)
    return {r.p: r.found for r in out.collect()}


def test_nearest_tolerance_and_ties(spark):
    out = lookup(spark, asof.asof_nearest, [3, 4.5, 10, 20], [(0, 1.0), (6, 2.0), (7, 3.0)], tolerance="3 hours", span="3 hours")
    assert out == {at(3): 2.0, at(4.5): 2.0, at(10): 3.0, at(20): None}


def test_nearest_without_tolerance(spark):
    out = lookup(spark, asof.asof_nearest, [-500, 900], [(0, 1.0), (6, 2.0)], span="1 hour")
    assert out == {at(-500): 1.0, at(900): 2.0}


def test_forward_is_strict_and_clamped(spark):
    history = [(0, 1.0), (6, 2.0)]
    out = lookup(spark, asof.asof_forward, [-3, -2.5, 3, 3.5, 6, 8.5, 9], history, span="4 hours")
    assert out == {
        at(-3): None, at(-2.5): 1.0, at(3): None, at(3.5): 2.0, at(6): 2.0, at(8.5): 2.0, at(9): None,
    }


def test_missing_value_of_the_nearest_row_stays_missing(spark):
    assert lookup(spark, asof.asof_nearest, [1], [(0, 5.0), (1, None)]) == {at(1): None}


def test_unmatched_series_keep_their_probes(spark):
    p = spark.createDataFrame([("a", at(0)), ("b", at(0))], "k string, p timestamp_ntz")
    h = spark.createDataFrame([("a", at(0), 1.0)], "k string, t timestamp_ntz, v double")
    out = asof.asof_nearest(p, h, "p", "t", "v", "found", "k")
    assert values(out, "k", "found") == [("a", 1.0), ("b", None)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    probes=st.sets(st.integers(0, 4000), min_size=1, max_size=30),
    history=st.sets(st.integers(0, 4000), min_size=1, max_size=30),
    tolerance=st.sampled_from([1, 60, 600]),
)
def test_lookups_against_brute_force(spark, probes, history, tolerance):
    ps, hs = sorted(probes), sorted(history)
    p = spark.createDataFrame([("a", at(m / 60), m) for m in ps], "k string, p timestamp_ntz, m int")
    h = spark.createDataFrame([("a", at(m / 60), float(m)) for m in hs], "k string, t timestamp_ntz, v double")
    near = {m: min(hs, key=lambda x: (abs(x - m), -x)) for m in ps}
    ahead = {m: min([x for x in hs if x >= m], default=hs[-1]) for m in ps}
    text = f"{tolerance} minutes"
    got = asof.asof_nearest(p, h, "p", "t", "v", "found", "k", text, "3 hours").collect()
    assert {r.m: r.found for r in got} == {m: float(x) if abs(x - m) <= tolerance else None for m, x in near.items()}
    got = asof.asof_forward(p, h, "p", "t", "v", "found", "k", text, "3 hours").collect()
    assert {r.m: r.found for r in got} == {m: float(x) if abs(x - m) < tolerance else None for m, x in ahead.items()}


def test_recurrence_boost(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", None), ("b", None), ("c", 9.0)], "k string, v double")
    assert values(asof.recurrence_boost(df, "v", "k"), "k", "found", "boost") == [("a", 1, 0.5), ("b", 0, 0.0), ("c", 1, 1.0)]


def test_session_has_to_be_utc(spark):
    df = series(spark, [0, 1])
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            windows.lags(df, {"p": ("v", 1)}, "k", "t", span="1 hour")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_task_gets_a_whole_series(spark):
    """The plan of the split form never exchanges on the series key alone, except chunk counts."""
    df = skewed(spark)
    plan = windows.lags(df, {"p": ("v", 1)}, "k", "t", span="1 hour")
    text = plan._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in text.splitlines() if "Exchange hashpartitioning(k#" in line and "_chunk" not in line and "_block" not in line]
    assert len(alone) <= 1
    assert "SinglePartition" not in text


def burst(spark):
    """One series with a burst of rows in a tenth of a second, and small ones."""
    quiet = spark.range(400).select(F.lit("hot").alias("k"), (F.col("id") * 3_600_000_000).alias("us"))
    dense = spark.range(4000).select(F.lit("hot").alias("k"), (F.lit(720_000_000_007) + F.col("id") * 25).alias("us"))
    rest = spark.range(300).select((F.col("id") % 7).cast("string").alias("k"), (F.col("id") * 7_919_000_000 + 13).alias("us"))
    df = quiet.union(dense).union(rest)
    return df.select("k", "us", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"), F.col("us").cast("double").alias("v"))


@pytest.mark.parametrize("rows", [50, 300, 10_000])
def test_no_slice_holds_more_rows(spark, rows):
    from seriesloom.operators import slices

    df = burst(spark)
    cut = slices.with_slices(df, "k", "us", rows)
    assert cut.columns == [*df.columns, "_chunk"] and cut.count() == df.count()
    sizes = cut.groupBy("k", "_chunk").agg(F.count("v").alias("n"), F.min("us").alias("a"), F.max("us").alias("z")).collect()
    assert max(r.n for r in sizes) <= rows
    hot = sorted((r._chunk, r.a, r.z) for r in sizes if r.k == "hot")
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))
    assert len(hot) <= 4 * 4400 // rows + 1


def test_equal_times_stay_together(spark):
    from seriesloom.operators import slices

    df = spark.range(500).select(F.lit("a").alias("k"), F.greatest(F.col("id") - 400, F.lit(0)).alias("us"))
    sizes = {r._chunk: r["count"] for r in slices.with_slices(df, "k", "us", 20).groupBy("_chunk").count().collect()}
    assert max(sizes.values()) >= 401 and sorted(sizes.values())[-2] <= 20


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 1000])
def test_binary_search(spark, n):
    from bisect import bisect_right

    from seriesloom.operators import slices

    values_ = sorted((i * 37) % 500 for i in range(n))
    df = spark.createDataFrame([(x, values_) for x in range(-1, 502, 7)], "x int, a array<int>")
    assert all(r.at == bisect_right(values_, r.x) for r in df.select("x", slices.bisect("a", F.col("x")).alias("at")).collect())


@pytest.mark.parametrize("tolerance", [None, "1 second", "40 minutes"])
def test_measured_slices_give_the_same_answers(spark, tolerance):
    past = burst(spark).withColumnRenamed("t", "at").drop("us")
    probes = burst(spark).select("k", (F.col("t") + F.expr("INTERVAL 11 MICROSECONDS")).alias("t"), F.col("us").alias("i"))
    probes = probes.unionByName(probes.select(F.lit("none").alias("k"), "t", "i").limit(3))
    fixed = asof.asof_nearest(probes, past, "t", "at", "v", "f", "k", tolerance, span="5 hours")
    for rows in (60, 1000):
        assert same(asof.asof_nearest(probes, past, "t", "at", "v", "f", "k", tolerance, span=None, rows=rows), fixed)
    if tolerance:
        ahead = asof.asof_forward(probes, past, "t", "at", "v", "f", "k", tolerance, span="5 hours")
        assert same(asof.asof_forward(probes, past, "t", "at", "v", "f", "k", tolerance, span=None, rows=60), ahead)
    with pytest.raises(Exception, match="without NULL"):
        asof.asof_nearest(probes.withColumn("k", F.nullif("k", F.lit("1"))), past, "t", "at", "v", "f", "k", span=None, rows=60).collect()
