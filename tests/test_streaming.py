import json
import os

import pytest
from pyspark.sql import functions as F

from seriesloom.sources import json_feeds
from seriesloom.streaming import lagged, live
from tests.helpers import at, values

SCHEMA = "k string, t timestamp_ntz, v double"


def land(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/b{i}")


def stream(spark, folder):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    return live.read_snapshots(spark, f"{folder}/in/*", schema, files_per_batch=1)


def test_buckets_close_with_the_watermark(spark, folder):
    land(spark, folder, [("a", at(0.5), 1.0), ("a", at(2), 3.0), ("b", at(1), 7.0)], [("a", at(10), 5.0)], [("a", at(20), 6.0)])
    out = live.live_buckets(stream(spark, folder), "t", "3 hours", [F.avg("v").alias("m")], "k")
    got = live.run_available(out, "test")
    assert values(got, "k", "t", "m") == [("a", at(0), 2.0), ("a", at(9), 5.0), ("b", at(0), 7.0)]


def test_late_rows_are_left_out(spark, folder):
    late = [("a", at(1), 100.0), ("a", at(60), 0.0)]
    land(spark, folder, [("a", at(0), 1.0)], [("a", at(30), 5.0)], [("a", at(40), 5.0)], late)
    out = live.live_buckets(stream(spark, folder), "t", "3 hours", [F.avg("v").alias("m")], "k")
    got = dict((t, m) for t, m in values(live.run_available(out, "test"), "t", "m"))
    assert got[at(30)] == 5.0 and got[at(0)] == 1.0


def test_redelivered_rows_count_once(spark, folder):
    rows = [("a", at(h / 10), float(h)) for h in range(20)]
    land(spark, folder, rows, rows + [("a", at(2), 50.0)], [("a", at(20), 0.0)])
    once = live.run_available(live.without_repeats(stream(spark, folder), ["k", "t", "v"], "t"), "test")
    assert once.count() == 22
    aggs = [F.count("v").alias("n")]
    out = live.live_buckets_deduped(stream(spark, folder), ["k", "t", "v"], "t", "3 hours", aggs, "k")
    assert values(live.run_available(out, "test"), "t", "n") == [(at(0), 21)]


LAGGED = {"one": ("m", 1), "three": ("m", 3)}


def closed_rows():
    return [(k, at(3 * i + 0.5), None if i % 5 == 2 else float(i)) for i in range(14) for k in ("a", "b") if not (k == "b" and i < 4)]


def in_batches(spark, folder, rows, cuts):
    ends = [0, *cuts, len(rows)]
    land(spark, folder, *[rows[a:b] for a, b in zip(ends, ends[1:])])
    buckets = live.live_buckets(stream(spark, folder), "t", "3 hours", [F.max("v").alias("m")], "k", lateness="1 hour")
    return buckets


@pytest.mark.parametrize("cuts", [(), (9,), (3, 4, 12, 20)])
def test_lags_in_any_batches_equal_the_batch_query(spark, folder, cuts):
    from seriesloom.operators import windows

    rows = closed_rows()
    got = lagged.run_lags(in_batches(spark, folder, rows, cuts), LAGGED, "k", "t", {"m": -1.0})
    whole = spark.createDataFrame([(k, t.replace(minute=0), v) for k, t, v in rows[:-4]], "k string, t timestamp_ntz, m double")
    wanted = windows.lags(windows.ffill(whole, "m", "k", "t"), LAGGED, "k", "t").na.fill(-1.0)
    columns = ("k", "t", "m", "one", "three")
    assert values(got, *columns) == values(wanted, *columns)


def test_a_batch_that_comes_again_changes_nothing(spark, folder):
    schema = "k string, t timestamp_ntz, m double"
    batches = [spark.createDataFrame([("a", at(3 * i + j), float(i + j)) for j in range(2)], schema) for i in range(0, 6, 2)]
    add = lambda n: lagged.add_batch(batches[n], n, folder, LAGGED, "k", "t")
    read = lambda: values(lagged.lagged_rows(spark, folder, batches[0].schema, LAGGED), "k", "t", "m", "one", "three")
    assert read() == []
    add(0), add(1)
    before = read()
    add(1), add(0)
    assert read() == before and lagged.done_batches(spark, folder) == [0, 1]
    # a batch that ended before its marker was set is made anew, from the same tail
    os.remove(f"{folder}/done/1")
    assert len(read()) == 2
    add(1)
    assert read() == before
    add(2)
    assert [r[3] for r in read()] == [None, *[r[2] for r in read()][:-1]]


def test_snapshots_in_batches_and_cut_files(spark, folder):
    """Overlapping snapshots, read file by file, equal the batch reading; a cut file is listed."""
    os.makedirs(f"{folder}/in")
    item = lambda i: {"time_tag": str(at(3 * i)), "Kp": i / 3, "a_running": str(i), "station_count": 8}
    texts = [json.dumps([item(i) for i in range(5)]), json.dumps({"data": [item(i) for i in range(3, 9)]}), json.dumps([item(9)])[:-4], " " + json.dumps([item(i) for i in range(8, 11)])]
    for n, text in enumerate(texts):
        with open(f"{folder}/in/{n}.json", "w") as file:
            file.write(text)
    files = json_feeds.stream_files(spark, f"{folder}/in", files_per_batch=1)
    rows, rejects = json_feeds.stream_object_json(files)
    timed = rows.withColumn("time_tag", F.col("time_tag").cast("timestamp_ntz"))
    once = live.run_available(live.without_repeats(timed, list(json_feeds.KP), "time_tag", "10 days"), "json")
    good = [f"{folder}/in/{n}.json" for n in (0, 1, 3)]
    whole = json_feeds.read_object_json(spark, good).distinct().withColumn("time_tag", F.col("time_tag").cast("timestamp_ntz"))
    read = lambda df: values(df.withColumn("time_tag", F.col("time_tag").cast("timestamp_ntz")), *json_feeds.KP)
    assert read(once) == read(whole) and len(read(once)) == 11
    assert [r.source_file.rpartition("/")[2] for r in live.run_available(rejects, "rejects").collect()] == ["2.json"]


def test_header_snapshots_as_a_stream(spark, folder):
    os.makedirs(f"{folder}/in")
    table = [["time_tag", "speed", "density"], ["2024-01-01 00:30:00", "400", "5"], ["2024-01-01 01:30:00", "", "x"]]
    other = [["density", "time_tag", "speed"], ["7", "2024-01-01 01:30:00", "410"], ["7", "2024-01-02 01:30:00", "420"]]
    for n, text in enumerate((json.dumps(table), json.dumps(other), "[[", json.dumps([["time_tag"]]))):
        with open(f"{folder}/in/{n}.json", "w") as file:
            file.write(text)
    files = json_feeds.stream_files(spark, f"{folder}/in", files_per_batch=2)
    rows, rejects = json_feeds.stream_header_json(files, ["speed", "density"])
    whole = json_feeds.read_header_json(spark, f"{folder}/in", ["speed", "density"], skip_unreadable=True)
    columns = ("time_tag", "speed", "density")
    made = live.run_available(rows, "header")
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r[c] for c in columns) for r in made.collect()) == key(tuple(r[c] for c in columns) for r in whole.collect())
    assert [r.source_file.rpartition("/")[2] for r in live.run_available(rejects, "rejects").collect()] == ["2.json"]
    buckets = live.live_buckets(rows.withColumn("k", F.lit("s")), "time_tag", "3 hours", [F.avg("speed").alias("m")], "k")
    assert values(live.run_available(buckets, "b"), "time_tag", "m") == [(at(0), 405.0)]
