"""Cases in which rows could get lost without a word: they fail or are listed."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.operators import ensemble, splits, windows
from seriesloom.plans import seasonal
from seriesloom.config import SeasonalConfig
from seriesloom.session import delete_path, intermediate, shared_dir
from seriesloom.sources import json_feeds
from tests.helpers import at


@pytest.fixture
def feed(folder):
    def land(**files):
        import os

        for name, text in files.items():
            with open(os.path.join(folder, f"{name}.json"), "w") as f:
                f.write(text if isinstance(text, str) else json.dumps(text))
        return folder

    return land


GOOD = [["time_tag", "speed"], ["2024-01-01 00:00:00", "400"], ["2024-01-01 00:01:00", "410"]]


def test_a_cut_file_fails_or_is_listed(spark, feed):
    path = feed(a=GOOD, b='[["time_tag", "speed"], ["2024-01-01 00:0')
    with pytest.raises(Exception, match="not the expected JSON"):
        json_feeds.read_header_json(spark, path, ["speed"]).collect()
    assert json_feeds.read_header_json(spark, path, ["speed"], skip_unreadable=True).count() == 2
    assert [r.source_file[-6:] for r in json_feeds.unreadable_files(spark, path).collect()] == "b.json".split()
    with pytest.raises(Exception, match="not the expected JSON"):
        json_feeds.header_of(spark, path)


def test_a_cut_object_file_fails(spark, feed):
    path = feed(a=[{"time_tag": "2024-01-01T00:00:00", "Kp": 1.0}], b='[{"time_tag": "2024-01-')
    with pytest.raises(Exception):
        json_feeds.read_object_json(spark, path).collect()


def test_headers_of_all_files_count(spark, feed):
    path = feed(a=GOOD, b=[["time_tag", "density"], ["2024-01-01 00:02:00", "5"]], c=[["time_tag"]])
    assert json_feeds.header_of(spark, path) == ["time_tag", "speed", "density"]
    rows = json_feeds.read_header_json(spark, path, ["speed", "density"]).collect()
    assert sorted((r.speed, r.density) for r in rows if r.speed) == [(400.0, None), (410.0, None)]
    assert [r.density for r in rows if r.density] == [5.0]


@pytest.mark.parametrize("as_table", [False, True])
def test_a_scenario_without_weight_fails(spark, as_table):
    df = spark.createDataFrame([("Quiet", 0, 1.0), ("Odd", 0, 2.0)], "scenario string, step int, kp double")
    weights = {"Quiet": 1.0}
    if as_table:
        weights = spark.createDataFrame(list(weights.items()), "scenario string, weight double")
    with pytest.raises(Exception, match="no weight for scenario Odd"):
        ensemble.weighted_by_step(df, "kp", weights).collect()


def test_short_series_keep_their_rows(spark):
    class Constant:
        def transform(self, df):
            return df.withColumn("prediction", F.col("ssn_lag_1m") + 1)

    rows = [(k, at(days=30 * i), float(i)) for k, n in (("long", 40), ("short", 10)) for i in range(n)]
    monthly = spark.createDataFrame(rows, "series_id string, time_tag timestamp_ntz, ssn double")
    made = seasonal.forecast_months(Constant(), monthly, "series_id", SeasonalConfig(months_ahead=3)).collect()
    got = {(r.series_id, r.step): (r.ssn, r.status) for r in made}
    assert got == {
        **{("long", i): (40.0 + i, "ok") for i in range(3)},
        **{("short", i): (None, "too few months") for i in range(3)},
    }


def test_series_outside_the_folds_are_listed(spark):
    rows = [(k, at(i), 1.0) for k, n in (("a", 400), ("b", 100), ("c", 35)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, time_tag timestamp_ntz, y double")
    status = {r.series_id: (r.rows, r.folds, r.status) for r in splits.fold_status(df, 5, 3, "series_id", min_rows=30).collect()}
    folds = splits.expanding_folds(df, 5, 3, "series_id", "time_tag", min_rows=30)
    took = {r.series_id: r.n for r in folds.groupBy("series_id").agg(F.countDistinct("fold").alias("n")).collect()}
    assert {k: v[1] for k, v in status.items() if v[1]} == took
    assert status["a"] == (400, 5, "ok") and status["c"][2] != "ok"


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="executors share"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))
    conf = SimpleNamespace(get=lambda name, default=None: "hdfs:///shared" if name == "spark.seriesloom.dir" else default)
    context.getConf = lambda: SimpleNamespace(get=lambda name, default=None: default)
    assert shared_dir(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs:///shared"


def test_intermediate_tables_are_deleted(spark):
    import os

    with intermediate(spark) as write:
        df = write(spark.range(5), "five")
        path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    delete_path(spark, path)  # a second time does nothing


def test_slices_follow_the_densest_hour(spark):
    """All rows of one series in one hour: no slice holds more than the bound."""
    quiet = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * 3_600_000_000).alias("us"))
    burst = spark.range(20_000).select(F.lit("a").alias("k"), (F.lit(7_200_000_000) + F.col("id") * 100_000).alias("us"))
    df = quiet.union(burst).select("k", "us", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"))
    span = windows.even_span(df, "k", "t", rows=1000)
    width = int(span.split()[0])
    most = df.groupBy(F.floor(F.col("us") / width)).count().agg(F.max("count")).first()[0]
    assert 100 < most <= 1000
    numbered = windows.number_rows(df, "k", ["t", "us"], windows.time_chunk("t", span), "at")
    assert numbered.agg(F.count_distinct("at"), F.max("at")).first() == (22_000, 21_999)


def test_written_tables_leave_the_session_as_it_was(spark):
    frames = [spark.range(1000).groupBy((F.col("id") % n).alias("k")).count() for n in (3, 5, 7, 9)]
    before = spark.conf.get(session.CLEANUP_SETTING)
    made = session.together(spark, [lambda f=f: session.written(f, "freed") for f in frames], "freed")
    assert [m.count() for m in made] == [3, 5, 7, 9]
    assert spark.conf.get(session.CLEANUP_SETTING) == before
    with session.intermediate(spark) as write:
        assert write(frames[0], "freed").count() == 3
    assert [f.count() for f in frames] == [3, 5, 7, 9]
