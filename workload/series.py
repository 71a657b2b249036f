"""Driver tables as time series; each function has a SQL view of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.clean import to_number
from seriesloom.operators.resample import resample
from workload.registry import R, r, view

PI = "3.141592653589793e0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props: str = "props") -> Column:
    return to_number(F.get_json_object(props, "$.k"))


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
STATION = "'S' || CAST(user_id % 3 AS VARCHAR)"


def station() -> Column:
    return F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("series_id")


def events(spark, sf_dir, *kinds: str) -> DataFrame:
    """Events with a station key, optionally of some types only."""
    ev = table(spark, sf_dir, "events")
    if kinds:
        ev = ev.where(F.col("event_type").isin(*kinds))
    return ev.select("event_id", station(), "user_id", "event_type", F.col("ts").alias("time_tag"), "value", "props")


def ev3h(spark, sf_dir) -> DataFrame:
    aggs = [r(F.avg("value"), 6).alias("v_mean"), F.min("value").alias("v_min"), F.count("value").alias("n")]
    return resample(events(spark, sf_dir), "time_tag", "3 hours", aggs)


view(
    "ev3h",
    f"""SELECT time_bucket(INTERVAL 3 HOUR, ts) AS time_tag, {R('avg(value)', 6)} AS v_mean,
    min(value) AS v_min, count(value) AS n FROM events GROUP BY 1""",
)


def ev3h_by_type(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("time_tag"), "value"
    )
    aggs = [r(F.avg("value"), 6).alias("v_mean"), F.min("value").alias("v_min"), F.count("value").alias("n")]
    return resample(ev, "time_tag", "3 hours", aggs, "series_id")


view(
    "ev3h_by_type",
    f"""SELECT event_type AS series_id, time_bucket(INTERVAL 3 HOUR, ts) AS time_tag,
    {R('avg(value)', 6)} AS v_mean, min(value) AS v_min, count(value) AS n FROM events GROUP BY 1, 2""",
)


def gappy(spark, sf_dir) -> DataFrame:
    """The same series without the buckets of a weekly outage, Mondays from 6 to 12 o'clock."""
    hour = F.hour("time_tag")
    outage = (F.dayofweek("time_tag") == 2) & (hour >= 6) & (hour < 12)
    return ev3h_by_type(spark, sf_dir).where(~outage)


view(
    "gappy",
    "SELECT * FROM ev3h_by_type WHERE NOT (isodow(time_tag) = 1 AND hour(time_tag) >= 6 AND hour(time_tag) < 12)",
)


def plasma(spark, sf_dir) -> DataFrame:
    aggs = [
        r(F.lit(300.0) + F.avg("value"), 6).alias("speed"),
        F.count("value").cast("double").alias("density"),
        F.min("value").alias("temperature"),
    ]
    return resample(events(spark, sf_dir, "view"), "time_tag", "15 minutes", aggs, "series_id")


view(
    "plasma",
    f"""SELECT {STATION} AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS time_tag,
    {R('300 + avg(value)', 6)} AS speed, CAST(count(value) AS DOUBLE) AS density, min(value) AS temperature
    FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
)


def mag(spark, sf_dir) -> DataFrame:
    aggs = [r(F.avg(k_of()) / 10 - 5, 6).alias("by_gsm"), r(F.avg("value") / 10 - 5, 6).alias("bz_gsm")]
    ev = events(spark, sf_dir, "click")
    out = resample(ev, "time_tag", "15 minutes", aggs, "series_id")
    return out.withColumn("bt", F.abs("bz_gsm") + 2.0)


view(
    "mag",
    f"""SELECT *, abs(bz_gsm) + 2.0 AS bt FROM (
    SELECT {STATION} AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS time_tag,
    {R(f'avg({K}) / 10 - 5', 6)} AS by_gsm, {R('avg(value) / 10 - 5', 6)} AS bz_gsm
    FROM events WHERE event_type = 'click' GROUP BY 1, 2)""",
)


def kp(spark, sf_dir) -> DataFrame:
    """3-hour index per station."""
    aggs = [r(F.least(F.lit(9.0), F.avg("value") / 12), 6).alias("Kp")]
    return resample(events(spark, sf_dir, "error"), "time_tag", "3 hours", aggs, "series_id")


view(
    "kp",
    f"""SELECT {STATION} AS series_id, time_bucket(INTERVAL 3 HOUR, ts) AS time_tag,
    {R('least(9.0, avg(value) / 12)', 6)} AS "Kp" FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
)


def hourly(spark, sf_dir) -> DataFrame:
    """Hourly archive per station, all seven columns."""
    aggs = [
        r(F.lit(300.0) + F.avg("value"), 6).alias("speed"),
        F.count("value").cast("double").alias("density"),
        r(F.avg("value") / 10 - 5, 6).alias("by_gsm"),
        r(F.avg(k_of()) / 5 - 10, 6).alias("bz_gsm"),
        r(F.least(F.lit(9.0), F.max("value") / 40), 6).alias("kp"),
    ]
    out = resample(events(spark, sf_dir), "time_tag", "1 hour", aggs, "series_id")
    return out.withColumn("bt", F.abs("bz_gsm") + 2.0)


view(
    "hourly",
    f"""SELECT *, abs(bz_gsm) + 2.0 AS bt FROM (
    SELECT {STATION} AS series_id, time_bucket(INTERVAL 1 HOUR, ts) AS time_tag,
    {R('300 + avg(value)', 6)} AS speed, CAST(count(value) AS DOUBLE) AS density,
    {R('avg(value) / 10 - 5', 6)} AS by_gsm, {R(f'avg({K}) / 5 - 10', 6)} AS bz_gsm,
    {R('least(9.0, max(value) / 40)', 6)} AS kp FROM events GROUP BY 1, 2)""",
)


def ship_archive(spark, sf_dir) -> DataFrame:
    """Archive of the model queries: one row per supplier nation and ship date, seven columns."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    day = F.col("l_shipdate").cast("date").cast("timestamp_ntz")
    out = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("series_id"), day.alias("time_tag"))
        .agg(
            r(F.lit(300.0) + F.avg(F.col("l_quantity").cast("double")) * 8, 6).alias("speed"),
            F.count("l_quantity").cast("double").alias("density"),
            r(F.avg(F.col("l_discount").cast("double")) * 100 - 5, 6).alias("by_gsm"),
            r(F.lit(4.0) - F.avg(F.col("l_tax").cast("double")) * 100, 6).alias("bz_gsm"),
            r(F.least(F.lit(9.0), F.max(F.col("l_quantity").cast("double")) / 6), 6).alias("kp"),
        )
    )
    return out.withColumn("bt", F.abs("bz_gsm") + 2.0)


view(
    "ship_archive",
    f"""SELECT *, abs(bz_gsm) + 2.0 AS bt FROM (
    SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS series_id, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS time_tag,
    {R('300 + avg(CAST(l_quantity AS DOUBLE)) * 8', 6)} AS speed, CAST(count(l_quantity) AS DOUBLE) AS density,
    {R('avg(CAST(l_discount AS DOUBLE)) * 100 - 5', 6)} AS by_gsm, {R('4.0 - avg(CAST(l_tax AS DOUBLE)) * 100', 6)} AS bz_gsm,
    {R('least(9.0, max(CAST(l_quantity AS DOUBLE)) / 6)', 6)} AS kp
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
)
view(
    "ship_frame",
    """SELECT series_id, time_tag, "Kp", kp_lag_3h FROM (
    SELECT series_id, time_tag, kp AS "Kp", lag(kp, 1) OVER w AS kp_lag_3h, lag(kp, 216) OVER w AS old
    FROM ship_archive WINDOW w AS (PARTITION BY series_id ORDER BY time_tag)) WHERE old IS NOT NULL""",
)
view(
    "ship_split",
    """SELECT *, pos < greatest(1, least(floor(0.75 * n), n - 1)) AS is_train FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time_tag) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
    FROM ship_frame)""",
)


def monthly_by_nation(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, F.col("c_nationkey") == nation.n_nationkey
    )
    return joined.groupBy(
        F.col("n_name").alias("series_id"), F.date_add(month, 14).cast("timestamp_ntz").alias("time_tag")
    ).agg(r(F.avg("o_totalprice") / 1000, 6).alias("ssn"))


view(
    "monthly_by_nation",
    f"""SELECT n_name AS series_id,
    CAST(date_trunc('month', o_orderdate) + INTERVAL 14 DAY AS TIMESTAMP) AS time_tag,
    {R('avg(o_totalprice) / 1000', 6)} AS ssn
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1, 2""",
)


# Which event type stands for which scenario.
SCENARIO_OF = {"click": "Quiet", "signup": "Quiet", "error": "Moderate", "view": "Moderate", "purchase": "Active"}


def scenario_name() -> Column:
    out = None
    for kind, name in SCENARIO_OF.items():
        hit = F.col("event_type") == kind
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.alias("scenario")


SCENARIO_SQL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in SCENARIO_OF.items()) + " END"


def draws(spark, sf_dir) -> DataFrame:
    """Ensemble draws: one per user, eight steps of three hours."""
    ev = events(spark, sf_dir).select(
        scenario_name(),
        F.col("user_id").alias("draw"),
        F.floor(F.hour("time_tag") / 3).alias("step"),
        "value",
    )
    return ev.groupBy("scenario", "draw", "step").agg(
        r(F.least(F.lit(9.0), F.avg("value") / 12), 6).alias("kp")
    )


view(
    "draws",
    f"""SELECT {SCENARIO_SQL} AS scenario, user_id AS draw, CAST(hour(ts) // 3 AS BIGINT) AS step,
    {R('least(9.0, avg(value) / 12)', 6)} AS kp FROM events GROUP BY 1, 2, 3""",
)


def paths(spark, sf_dir) -> DataFrame:
    """One trajectory per scenario: the mean over its draws, with a time per step."""
    out = draws(spark, sf_dir).groupBy("scenario", "step").agg(r(F.avg("kp"), 6).alias("kp"))
    start = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    hours = F.make_dt_interval(F.lit(0), (F.col("step") * 3).cast("int"))
    return out.withColumn("time_tag", start + hours)


view(
    "paths",
    f"""SELECT scenario, step, {R('avg(kp)', 6)} AS kp,
    TIMESTAMP '2024-02-01 00:00:00' + to_hours(3 * step) AS time_tag FROM draws GROUP BY 1, 2""",
)


def pairs(spark, sf_dir) -> DataFrame:
    """Observed and forecast values per series: the value, the one before, and a mean of three."""
    from seriesloom.operators.windows import lags

    base = ev3h_by_type(spark, sf_dir).select(
        "series_id", "time_tag", r(F.least(F.lit(9.0), F.col("v_mean") / 12), 6).alias("y")
    )
    shifted = lags(base, {"lag1": ("y", 1), "lag2": ("y", 2), "lag3": ("y", 3)}, "series_id", "time_tag")
    mean = r((F.col("lag1") + F.col("lag2") + F.col("lag3")) / 3, 6)
    return shifted.na.drop("any").select("series_id", "time_tag", "y", "lag1", mean.alias("p"))


view(
    "pairs",
    f"""SELECT series_id, time_tag, y, lag1, {R('(lag1 + lag2 + lag3) / 3', 6)} AS p FROM (
    SELECT *, lag(y, 1) OVER w AS lag1, lag(y, 2) OVER w AS lag2, lag(y, 3) OVER w AS lag3 FROM (
      SELECT series_id, time_tag, {R('least(9.0, v_mean / 12)', 6)} AS y FROM ev3h_by_type)
    WINDOW w AS (PARTITION BY series_id ORDER BY time_tag)) WHERE lag3 IS NOT NULL""",
)


MONTH_W = "PARTITION BY series_id ORDER BY time_tag"
view(
    "month_split",
    f"""SELECT *, pos < greatest(12, least(floor(0.85 * n), n - 12)) AS is_train FROM (
    SELECT *, row_number() OVER ({MONTH_W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM (
      SELECT series_id, time_tag, lead(ssn, 1) OVER ({MONTH_W}) AS y, lag(ssn, 36) OVER ({MONTH_W}) AS old FROM monthly_by_nation)
    WHERE old IS NOT NULL AND y IS NOT NULL)""",
)
view(
    "months_ahead",
    """SELECT series_id, step, CAST(date_trunc('month', last_month) + to_months(CAST(step + 1 AS INTEGER)) + INTERVAL 14 DAY AS TIMESTAMP) AS time_tag, months FROM (
    SELECT series_id, max(time_tag) AS last_month, count(*) AS months, unnest(range(12)) AS step FROM monthly_by_nation GROUP BY 1)""",
)
view(
    "ensemble_draws",
    f"SELECT DISTINCT {STATION} AS series_id, {SCENARIO_SQL} AS scenario, user_id AS draw FROM events",
)
