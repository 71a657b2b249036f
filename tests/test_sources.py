import json
import os

import pytest
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.operators.clean import dedupe_exact
from seriesloom.sources import documents, json_feeds, stores, text_feeds
from tests.helpers import at, values


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_header_json(spark, folder):
    put(folder, "a.json", json.dumps([["time_tag", "density", "speed"], ["2024-01-01 03:00:00", "5.5", "400"], ["2024-01-01 00:00:00", "abc", None]]))
    put(folder, "b.json", json.dumps([["speed", "time_tag"], ["", "2024-01-02 00:00:00"], [410.5, "never"]]))
    put(folder, "c.json", json.dumps([["time_tag", "density", "speed"]]))
    out = json_feeds.read_header_json(spark, folder, ["density", "speed"])
    assert values(out, "time_tag", "density", "speed") == [
        (at(0), None, None), (at(3), 5.5, 400.0), (at(0, days=1), None, None), (None, None, 410.5),
    ]
    assert json_feeds.read_header_json(spark, folder, ["density", "speed"], drop_all_null=True).count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        json_feeds.read_header_json(spark, folder, ["density"], strict_time=True).collect()
    assert json_feeds.header_of(spark, os.path.join(folder, "a.json")) == ["time_tag", "density", "speed"]


def test_object_json_in_both_forms(spark, folder):
    rows = [{"time_tag": "2024-01-01T00:00:00", "Kp": 1.67, "a_running": 6, "station_count": 8},
            {"time_tag": "2024-01-01T03:00:00", "Kp": "2.33", "a_running": 9, "station_count": 8}]
    changed = [{**rows[0], "Kp": 2.0}, {**rows[1], "Kp": None}]
    put(folder, "a.json", json.dumps(rows, indent=1))
    put(folder, "b.json", json.dumps({"data": rows[:1] + changed}))
    raw = dedupe_exact(json_feeds.read_object_json(spark, folder), json_feeds.KP)
    out = json_feeds.typed_objects(raw, "time_tag", {"Kp": "Kp"})
    assert values(out, "time_tag", "Kp") == [(at(0), 1.67), (at(0), 2.0), (at(3), 2.33)]


def archive_line(width=42, **over):
    fields = {0: "2024", 1: "1", 2: "5", 9: "6.0", 15: "-2.0", 16: "-3.5", 23: "7.0", 24: "450.", 38: "27"}
    fields.update({int(k[1:]): v for k, v in over.items()})
    return "  ".join(fields.get(i, "0") for i in range(width))


def test_hourly_archive(spark, folder):
    lines = [
        "Yr DOY", "-- --", "", "   ", archive_line(), archive_line(39, f2="6"), archive_line(f2="7", f24="9999."),
        archive_line(f2="8", f24="99999.9"), archive_line(f2="9", f9="999.9"), archive_line(f2="10", f38="99"),
        archive_line(f2="x"), archive_line(f2="11", f16="bad"), "\t" + archive_line(f2="12", f9="999.95"),
        archive_line(f0="99999", f2="13"),
    ]
    put(folder, "archive/2023.txt", archive_line(f24="300."))
    put(folder, "archive/2024.txt", "\n".join(lines))
    out = text_feeds.read_hourly_archive(spark, f"{folder}/archive")
    assert values(out, "time_tag", "speed", "bt", "kp") == [(at(5), 450.0, 6.0, 2.7), (at(12), 450.0, 999.95, 2.7)]


def test_short_archive(spark, folder):
    good = "2024 1 1 5 0 0 400.0 5.0 0 6.0 -1.0 27"
    lines = [good, "2024 1 1 6 0 0 99999.9 5.0 0 6.0 -1.0 27", "2024 1 1 7 0 0 400 5 0 6", "2024 13 1 8 0 0 1 5 0 6 7 27", "2024 1 1 9 0 0 400.0 5.0 0 6.0 -1.0 99"]
    put(folder, "s.txt", "\n".join(lines))
    assert values(text_feeds.read_short_archive(spark, folder), "time_tag", "speed", "kp") == [(at(5), 400.0, 2.7)]


def test_monthly_text(spark, folder):
    put(folder, "m.txt", "# head\n\n2024 01 2024.04 123.0 9 1 0\n2024 02 2024.1 -1.0 -1 0 1\n2024 xx 0 5\n2024 03\n2024 12 0 0.0\n")
    out = text_feeds.read_monthly_text(spark, folder)
    assert [(t.month, t.day, v) for t, v in values(out, "time_tag", "ssn")] == [(1, 15, 123.0), (12, 15, 0.0)]


def test_year_store(spark, folder):
    path = f"{folder}/years"
    assert stores.missing_years(spark, path, 2023, 3, 2025) == [2023, 2024, 2025]
    rows = [(at(0, days=-10), 1.0), (at(0), 2.0), (at(0, days=400), 3.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    stores.write_years(df, path, "t")
    stores.write_years(df.where("v = 2.0").withColumn("v", F.lit(9.0)), path, "t")
    assert values(stores.read_years(spark, path, 2023, 2), "v", "year") == [(1.0, 2023), (9.0, 2024)]
    plan = stores.read_years(spark, path, 2024, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert stores.missing_years(spark, path, 2023, 4, 2025) == [2025, 2026]


def test_metrics_store(spark, folder):
    m = spark.createDataFrame([(0.45,)], "mae double")
    for years, value in ((5, 0.45), (8, 0.5), (5, 0.4)):
        stores.write_metrics(m.withColumn("mae", F.lit(value)), f"{folder}/m", {"start_year": 2020, "years": years})
    assert values(stores.read_metrics(spark, f"{folder}/m", {"start_year": 2020, "years": 5}), "mae") == [(0.4,)]


def test_documents_keep_nulls_and_order(spark, folder):
    steps = spark.createDataFrame([("x", 1, at(3), None), ("x", 0, at(0), 1.5)], "key string, step int, time_tag timestamp_ntz, mean double")
    scen = spark.createDataFrame([("x", "Quiet", 1, 2.0), ("x", "Quiet", 0, 1.0), ("x", "Active", 0, None)], "key string, scenario string, step int, kp double")
    docs = documents.forecast_arrays(scen, steps, "key", "kp")
    documents.write_documents(docs, f"{folder}/docs")
    text = "".join(r.value for r in spark.read.text(f"{folder}/docs").collect())
    assert json.loads(text) == {
        "key": "x",
        "forecast": {
            "times": ["2024-01-01T00:00:00+00:00", "2024-01-01T03:00:00+00:00"],
            "by_scenario": {"Active": [None], "Quiet": [1.0, 2.0]},
            "mean": [1.5, None],
        },
    }


def test_shared_folder_follows_the_cluster(spark):
    named = spark.sparkContext.getConf().get(session.CHECKPOINT_SETTING)
    used = session.shared_dir(spark)
    assert used == named if named else os.path.isdir(used)
    assert session.fresh_path(spark, "a") != session.fresh_path(spark, "a")


def test_readers_see_whole_versions(spark, folder):
    """Two writers of one name and a reader at the same time."""
    import threading

    from seriesloom.sources import publish as p

    base, stop, seen = f"{folder}/table", threading.Event(), set()
    assert p.current(spark, base) is None

    def write(value):
        for _ in range(3):
            p.publish(spark, base, spark.range(100).select(F.lit(value).alias("v")).repartition(2).write.parquet)

    def read():
        while not stop.is_set():
            if at_ := p.current(spark, base):
                seen.add(tuple(sorted((r.v, r["count"]) for r in spark.read.parquet(at_).groupBy("v").count().collect())))

    threads = [threading.Thread(target=write, args=(v,)) for v in (1, 2)]
    reader = threading.Thread(target=read)
    for t in (*threads, reader):
        t.start()
    for t in threads:
        t.join()
    stop.set()
    reader.join()
    assert seen <= {((1, 100),), ((2, 100),)} and seen
    with pytest.raises(RuntimeError):
        p.publish(spark, base, lambda path: (_ for _ in ()).throw(RuntimeError()))
    kept = p.current(spark, base)
    assert spark.read.parquet(kept).count() == 100
    assert len(p.expire(spark, base, 0.0)) == 5 and p.current(spark, base) == kept


def test_years_come_from_a_listing(spark, folder):
    """Neither a table nor its schema is read."""
    df = spark.createDataFrame([(at(0), 1.0), (at(0, days=800), 2.0), (None, 3.0)], "t timestamp_ntz, v double")
    stores.write_years(df, f"{folder}/y", "t")
    for name in os.listdir(f"{folder}/y/data"):
        os.chmod(f"{folder}/y/data/{name}", 0)
    try:
        assert stores.missing_years(spark, f"{folder}/y", 2023, 5, 2027) == [2023, 2025, 2027]
    finally:
        for name in os.listdir(f"{folder}/y/data"):
            os.chmod(f"{folder}/y/data/{name}", 0o755)
    assert stores.read_years(spark, f"{folder}/y", 1990, 2).count() == 0
    with pytest.raises(ValueError, match="no years"):
        stores.read_years(spark, f"{folder}/none", 1990, 2)


def test_metrics_by_part_of_a_setup(spark, folder):
    m = spark.createDataFrame([(0.45,)], "mae double")
    for years in (5, 8):
        stores.write_metrics(m.withColumn("mae", F.lit(float(years))), f"{folder}/m", {"start_year": 2020, "years": years})
    assert values(stores.read_metrics(spark, f"{folder}/m", {"start_year": 2020}), "mae") == [(5.0,), (8.0,)]
