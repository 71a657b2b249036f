"""Sources and sinks: derived series are landed in the feeds' formats, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.clean import dedupe, dedupe_exact
from seriesloom.operators.resample import resample
from seriesloom.session import fresh_path
from seriesloom.sources import documents, json_feeds, stores, text_feeds
from workload.registry import R, n, query, r
from workload.series import K, k_of, table


def _quarter_hours(spark, sf_dir) -> DataFrame:
    aggs = [
        F.count("value").alias("n"),
        r(F.lit(300.0) + F.avg("value"), 6).alias("speed"),
        F.min("value").alias("temperature"),
    ]
    ev = table(spark, sf_dir, "events").withColumnRenamed("ts", "time_tag")
    return resample(ev, "time_tag", "15 minutes", aggs)


QUARTER = f"""(SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS time_tag, count(value) AS n,
    {R('300 + avg(value)', 6)} AS speed, min(value) AS temperature FROM events GROUP BY 1)"""


def _land_tables(df: DataFrame, header: list[str], label: str) -> str:
    """One ``[[header], [row], ...]`` file per day; a day holds at most 96 quarter hours."""
    row = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header])
    day = F.to_date("_at").alias("day")
    rows = df.select(day, F.struct(F.col("_at"), row.alias("row")).alias("s"))
    docs = rows.groupBy("day").agg(F.array_sort(F.collect_list("s")).alias("s"))
    table_ = F.concat(F.array(F.array(*[F.lit(c) for c in header])), F.transform("s", lambda x: x["row"]))
    path = fresh_path(df.sparkSession, label)
    docs.select("day", F.to_json(table_).alias("value")).write.partitionBy("day").text(path)
    return path


def _plasma_rows(spark, sf_dir) -> DataFrame:
    q = _quarter_hours(spark, sf_dir)
    bad = F.hour("time_tag") < 6
    return q.select(
        F.col("time_tag").alias("_at"),
        F.date_format("time_tag", "yyyy-MM-dd HH:mm:ss").alias("time_tag"),
        F.col("n").cast("string").alias("density"),
        F.col("speed").cast("string").alias("speed"),
        F.when(bad, "bad").otherwise(F.col("temperature").cast("string")).alias("temperature"),
    )


@query(
    "scan_header_json",
    f"""SELECT time_tag, CAST(n AS DOUBLE) AS density, speed, CASE WHEN hour(time_tag) >= 6 THEN temperature END AS temperature
    FROM {QUARTER}""",
)
def scan_header_json(spark, sf_dir):
    path = _land_tables(_plasma_rows(spark, sf_dir), ["time_tag", "density", "speed", "temperature"], "plasma")
    columns = [c for c in json_feeds.header_of(spark, path) if c != "time_tag"]
    return json_feeds.read_header_json(spark, path, columns, strict_time=True)


@query(
    "scan_header_json_drop_empty",
    f"""SELECT CASE WHEN minute(time_tag) < 45 THEN time_tag END AS time_tag, CAST(n AS DOUBLE) AS density, speed,
    CASE WHEN hour(time_tag) >= 6 THEN temperature END AS temperature FROM {QUARTER} WHERE hour(time_tag) <> 12""",
)
def scan_header_json_drop_empty(spark, sf_dir):
    """Another column order, unreadable times, and an hour of the day without any value."""
    rows = _plasma_rows(spark, sf_dir)
    silent = F.hour("_at") == 12
    columns = {c: F.when(silent, "x").otherwise(F.col(c)) for c in ("density", "speed", "temperature")}
    time = F.when(F.minute("_at") < 45, F.col("time_tag")).otherwise("not a time")
    rows = rows.withColumns({**columns, "time_tag": time})
    path = _land_tables(rows, ["speed", "time_tag", "temperature", "density"], "plasma")
    return json_feeds.read_header_json(spark, path, ["density", "speed", "temperature"], drop_all_null=True)


def _kp_rows(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumnRenamed("ts", "time_tag")
    aggs = [r(F.least(F.lit(9.0), F.avg("value") / 12), 6).alias("Kp"), F.count("value").alias("n")]
    return resample(ev, "time_tag", "3 hours", aggs)


KP = f"""(SELECT time_bucket(INTERVAL 3 HOUR, ts) AS time_tag, {R('least(9.0, avg(value) / 12)', 6)} AS "Kp", count(value) AS n
    FROM events GROUP BY 1)"""


def _land_kp(spark, sf_dir) -> str:
    """Two-day snapshots, so each row is delivered twice; every other file wraps its array."""
    rows = _kp_rows(spark, sf_dir)
    item = F.struct(
        F.date_format("time_tag", "yyyy-MM-dd'T'HH:mm:ss").alias("time_tag"),
        F.col("Kp"),
        (F.col("n") % 7).alias("a_running"),
        F.lit(8).alias("station_count"),
    )
    items = rows.select(F.to_date("time_tag").alias("first"), item.alias("i"))
    twice = items.select("i", F.explode(F.array("first", F.date_add("first", 1))).alias("day"))
    docs = twice.groupBy("day").agg(F.array_sort(F.collect_list("i")).alias("d"))
    body = F.when(F.dayofyear("day") % 2 == 0, F.to_json(F.struct(F.col("d").alias("data")))).otherwise(F.to_json("d"))
    path = fresh_path(spark, "kp")
    docs.select("day", body.alias("value")).write.partitionBy("day").text(path)
    return path


@query("scan_object_json", f'SELECT time_tag, "Kp" FROM {KP}')
def scan_object_json(spark, sf_dir):
    raw = json_feeds.read_object_json(spark, _land_kp(spark, sf_dir))
    once = dedupe_exact(raw, json_feeds.KP)
    return json_feeds.typed_objects(once, "time_tag", {"Kp": "Kp"})


@query(
    "scan_object_json_first_per_time",
    f'SELECT time_tag, "Kp" FROM {KP}',
)
def scan_object_json_first_per_time(spark, sf_dir):
    raw = json_feeds.read_object_json(spark, _land_kp(spark, sf_dir))
    typed = json_feeds.typed_objects(raw, "time_tag", {"Kp": "Kp", "a_running": "a"})
    return dedupe(typed, "time_tag", ["a"], "first").drop("a")


@query("scan_kp_table_form", f'SELECT time_tag, "Kp" FROM {KP}')
def scan_kp_table_form(spark, sf_dir):
    rows = _kp_rows(spark, sf_dir)
    rows = rows.select(F.col("time_tag").alias("_at"), rows["time_tag"].cast("string").alias("time_tag"), rows["Kp"].cast("string").alias("Kp"))
    path = _land_tables(rows, ["time_tag", "Kp"], "kp-table")
    return json_feeds.read_header_json(spark, path, ["Kp"]).na.drop("any")


def _daily(spark, sf_dir) -> DataFrame:
    """One archive row per day of the orders table: several years."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count("o_orderkey").alias("n"),
        r(F.avg("o_totalprice") / 500, 3).alias("speed"),
        r(F.min("o_totalprice") / 5000, 3).alias("bt"),
        r(F.max("o_totalprice") / 20000 - 10, 3).alias("bz"),
        F.floor(F.max("o_totalprice") / 6000).alias("kp10"),
    )


DAILY = f"""(SELECT CAST(o_orderdate AS DATE) AS day, count(o_orderkey) AS n, {R('avg(o_totalprice) / 500', 3)} AS speed,
    {R('min(o_totalprice) / 5000', 3)} AS bt, {R('max(o_totalprice) / 20000 - 10', 3)} AS bz,
    CAST(floor(max(o_totalprice) / 6000) AS BIGINT) AS kp10 FROM orders GROUP BY 1)"""


def _archive_line(fields: dict[int, Column], width: int) -> Column:
    return F.concat_ws("   ", *[fields.get(i, F.lit("0")) for i in range(width)])


def _land_archive(spark, sf_dir) -> str:
    """Yearly text with header and short lines, fill codes and unreadable numbers among the rows."""
    d = _daily(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in ("speed", "bt", "bz", "n", "kp10")}
    fields = {
        0: F.year("day").cast("string"),
        1: F.dayofyear("day").cast("string"),
        2: (F.col("n") % 24).cast("string"),
        9: text["bt"],
        15: F.when(F.dayofmonth("day") == 11, "999.9").otherwise((F.col("n") / 2).cast("string")),
        16: text["bz"],
        23: F.when(F.dayofmonth("day") == 13, "n/a").otherwise(text["n"]),
        24: F.when(F.dayofmonth("day") == 7, "9999.").otherwise(text["speed"]),
        38: text["kp10"],
    }
    lines = d.select(F.year("day").alias("in_year"), _archive_line(fields, 42).alias("value"))
    short = d.select(F.year("day").alias("in_year"), _archive_line(fields, 39).alias("value"))
    noise = d.select(F.year("day").alias("in_year")).distinct()
    noise = noise.select("in_year", F.explode(F.array(F.lit("Yr DOY HR ..."), F.lit("  "), F.lit("-- --"))).alias("value"))
    path = fresh_path(spark, "archive")
    lines.unionByName(short).unionByName(noise).write.partitionBy("in_year").text(path)
    return path


ARCHIVE = f"""(SELECT day + to_hours(n % 24) AS time_tag, speed, CAST(n AS DOUBLE) AS density, n / 2 AS by_gsm, bz AS bz_gsm, bt,
    kp10 / 10 AS kp FROM {DAILY} WHERE day(day) NOT IN (7, 11, 13))"""


@query("scan_hourly_archive", f"SELECT * FROM {ARCHIVE}")
def scan_hourly_archive(spark, sf_dir):
    return text_feeds.read_hourly_archive(spark, _land_archive(spark, sf_dir))


@query(
    "scan_short_archive",
    f"SELECT day + to_hours(n % 24) AS time_tag, speed, CAST(n AS DOUBLE) AS density, bt, bz AS bz_gsm, kp10 / 10 AS kp FROM {DAILY} WHERE day(day) <> 7",
)
def scan_short_archive(spark, sf_dir):
    d = _daily(spark, sf_dir)
    fields = {
        0: F.year("day").cast("string"),
        1: F.month("day").cast("string"),
        2: F.dayofmonth("day").cast("string"),
        3: (F.col("n") % 24).cast("string"),
        6: F.when(F.dayofmonth("day") == 7, "99999.9").otherwise(F.col("speed").cast("string")),
        7: F.col("n").cast("string"),
        9: F.col("bt").cast("string"),
        10: F.col("bz").cast("string"),
        11: F.col("kp10").cast("string"),
    }
    path = fresh_path(spark, "short-archive")
    d.select(_archive_line(fields, 12).alias("value")).write.text(path)
    return text_feeds.read_short_archive(spark, path)


@query(
    "scan_monthly_text",
    f"""SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 14 DAY AS TIMESTAMP) AS time_tag, {R('avg(o_totalprice) / 1000', 3)} AS ssn
    FROM orders GROUP BY 1 HAVING month(min(o_orderdate)) <> 12""",
)
def scan_monthly_text(spark, sf_dir):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    m = table(spark, sf_dir, "orders").groupBy(month).agg(r(F.avg("o_totalprice") / 1000, 3).alias("ssn"))
    value = F.when(F.month("month") == 12, "-1").otherwise(F.col("ssn").cast("string"))
    line = F.concat_ws("  ", F.year("month"), F.lpad(F.month("month").cast("string"), 2, "0"), F.lit("0"), value, F.lit("3.1 9 1"))
    lines = m.select(line.alias("value")).unionByName(
        m.select(F.explode(F.array(F.lit("# notes"), F.lit(""), F.lit("1999 01"))).alias("value"))
    )
    path = fresh_path(spark, "monthly")
    lines.write.text(path)
    return text_feeds.read_monthly_text(spark, path)


@query("store_by_year", f"SELECT CAST(day AS TIMESTAMP) AS day, year(day) AS year, CASE WHEN year(day) = 1998 THEN speed + 1 ELSE speed END AS speed FROM {DAILY} WHERE year(day) BETWEEN 1997 AND 1999")
def store_by_year(spark, sf_dir):
    """Write all years, write one again, read three: the other years stay as they were."""
    rows = _daily(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("day"), "speed")
    path = fresh_path(spark, "years")
    stores.write_years(rows, path, "day")
    changed = rows.where(F.year("day") == 1998).withColumn("speed", F.col("speed") + 1)
    stores.write_years(changed, path, "day")
    return stores.read_years(spark, path, 1997, 3).withColumn("year", n("year"))


@query("scan_year_range", f"SELECT * FROM {ARCHIVE} WHERE time_tag >= TIMESTAMP '1998-01-01' AND time_tag < TIMESTAMP '2000-01-01'")
def scan_year_range(spark, sf_dir):
    """Two of the landed yearly folders; Spark lists and opens only these."""
    path = _land_archive(spark, sf_dir)
    return text_feeds.read_hourly_archive(spark, [f"{path}/in_year={y}" for y in (1998, 1999)])


@query("union_of_years", f"SELECT * FROM {ARCHIVE}")
def union_of_years(spark, sf_dir):
    """One frame per landed year, of which there are few; the first comes twice."""
    path = _land_archive(spark, sf_dir)
    found = spark.read.text(path).select("in_year").distinct().collect()
    parts = [text_feeds.read_hourly_archive(spark, f"{path}/in_year={y}") for y in sorted(r.in_year for r in found)]
    out = parts[0]
    for part in [*parts[1:], parts[0]]:
        out = out.unionByName(part)
    return dedupe(out, "time_tag", ["time_tag"], "last")


@query(
    "missing_years",
    f"""SELECT y AS year FROM (SELECT unnest(range(1995, 2001)) AS y) WHERE y = 1999 OR y NOT IN (SELECT year(day) FROM {DAILY} WHERE year(day) % 2 = 1)""",
)
def missing_years(spark, sf_dir):
    """Years of a range that a store of the odd ones lacks, and the current year."""
    path = fresh_path(spark, "years")
    stores.write_years(_daily(spark, sf_dir).where(F.year("day") % 2 == 1), path, "day")
    found = stores.missing_years(spark, path, 1995, 6, 1999)
    return spark.createDataFrame([(y,) for y in found], "year long")


@query(
    "result_documents",
    f"""SELECT x.step, strftime(time_tag, '%Y-%m-%dT%H:%M:%S+00:00') AS time, {R('active')} AS active, {R('mean')} AS mean FROM (
      SELECT step, min(time_tag) AS time_tag, max(CASE WHEN scenario = 'Active' THEN kp END) AS active, avg(kp) AS mean FROM paths GROUP BY 1) x""",
)
def result_documents(spark, sf_dir):
    """Write the forecast of all scenarios as one document, read the file, take it apart again."""
    from workload.series import paths

    p = paths(spark, sf_dir)
    by_step = p.groupBy("step").agg(F.min("time_tag").alias("time_tag"), F.avg("kp").alias("mean"))
    one = F.lit("all").alias("key")
    docs = documents.forecast_arrays(p.select("*", one), by_step.select("*", one), "key", "kp")
    path = fresh_path(spark, "documents")
    documents.write_documents(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    rows = back.select("forecast", F.posexplode("forecast.times").alias("step", "time"))
    at = F.col("step")
    return rows.select(
        n("step").alias("step"),
        "time",
        r(F.col("forecast.by_scenario")["Active"][at]).alias("active"),
        r(F.col("forecast.mean")[at]).alias("mean"),
    )


@query(
    "metrics_store",
    f"""SELECT event_type AS series_id, {R('avg(value)')} AS mae, 2020 AS start_year, 5 AS years, 0.75 AS train_fraction
    FROM events GROUP BY 1""",
)
def metrics_store(spark, sf_dir):
    """Metrics under two setups; rewriting one leaves the other, and reading names its setup."""
    ev = table(spark, sf_dir, "events")
    m = ev.groupBy(F.col("event_type").alias("series_id")).agg(r(F.avg("value")).alias("mae"))
    path = fresh_path(spark, "metrics")
    setup = {"start_year": 2020, "years": 5, "train_fraction": 0.75}
    stores.write_metrics(m.withColumn("mae", F.lit(0.0)), path, setup)
    stores.write_metrics(m.withColumn("mae", F.lit(1.0)), path, {**setup, "years": 8})
    stores.write_metrics(m, path, setup)
    return stores.read_metrics(spark, path, setup)


@query(
    "field_map_variants",
    f"SELECT event_id, {R(K, 2)} AS k FROM events WHERE event_type <> 'signup'",
)
def field_map_variants(spark, sf_dir):
    """A text feed with other field numbers; a field given as negative counts from the end."""
    ev = table(spark, sf_dir, "events")
    k = F.when(F.col("event_type") == "signup", "?").otherwise(k_of().cast("string"))
    path = fresh_path(spark, "fields")
    ev.select(F.concat_ws(" ", F.lit(" a"), F.col("event_id"), F.lit("b"), k).alias("value")).write.text(path)
    fields = {"event_id": (1, "bigint"), "k": (-1, "double")}
    return text_feeds.read_fixed_text(spark, path, fields, 4).select("event_id", r("k", 2).alias("k"))
