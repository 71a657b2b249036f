"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import domain as d
from seriesloom.functions import timeaxis as t
from workload.registry import R, n, query, r
from workload.series import PI, ev3h_by_type, hourly, kp, monthly_by_nation, table

COUPLING = "pow(speed, 4.0e0/3) * pow(bt, 2.0e0/3) * pow(sin(atan2(abs(by_gsm), bz_gsm) / 2), 8.0e0/3)"


@query(
    "physics_terms",
    f"""SELECT series_id, time_tag, {R(COUPLING, 2)} AS coupling, {R('density * pow(speed / 100, 2)')} AS pressure,
    {R('speed * greatest(0.0, -bz_gsm) / 1000')} AS vbs, {R(f'cos(4 * {PI} * (dayofyear(time_tag) - 80) / 365.25e0)')} AS season,
    {R('pow(speed, 4.0e0/3) * pow(bt, 2.0e0/3)', 2)} AS simple_coupling FROM hourly""",
)
def physics_terms(spark, sf_dir):
    return hourly(spark, sf_dir).select(
        "series_id",
        "time_tag",
        r(d.coupling("speed", "bt", "by_gsm", "bz_gsm"), 2).alias("coupling"),
        r(d.ram_pressure("density", "speed")).alias("pressure"),
        r(d.southward_field("speed", "bz_gsm")).alias("vbs"),
        r(d.equinox_term("time_tag")).alias("season"),
        r(d.coupling_without_angle("speed", "bt"), 2).alias("simple_coupling"),
    )


@query(
    "coupling_of_negative_field",
    f"""SELECT series_id, time_tag, CASE WHEN bz_gsm >= 0 THEN {R('pow(speed, 4.0e0/3) * pow(bz_gsm, 2.0e0/3)', 2)} END AS c FROM hourly""",
)
def coupling_of_negative_field(spark, sf_dir):
    return hourly(spark, sf_dir).select(
        "series_id", "time_tag", r(d.coupling_without_angle("speed", "bz_gsm"), 2).alias("c")
    )


@query(
    "fourier_terms",
    f"""SELECT series_id, time_tag, m AS month, {R(f'sin(2 * {PI} * m / 132)')} AS sin_11yr, {R(f'cos(2 * {PI} * m / 132)')} AS cos_11yr,
    {R(f'sin(4 * {PI} * m / 132)')} AS sin_5p5yr, {R(f'cos(4 * {PI} * m / 132)')} AS cos_5p5yr FROM (
    SELECT *, CAST((year(time_tag) - 1749) * 12 + month(time_tag) - 1 AS BIGINT) AS m FROM monthly_by_nation)""",
)
def fourier_terms(spark, sf_dir):
    month = t.month_index("time_tag")
    terms = [r(c).alias(k) for k, c in d.fourier_terms(month, 132).items()]
    return monthly_by_nation(spark, sf_dir).select("series_id", "time_tag", n(month).alias("month"), *terms)


KP_SQL = """CASE WHEN "Kp" < 4 THEN 'Quiet' WHEN "Kp" < 5 THEN 'Unsettled / Active' WHEN "Kp" < 6 THEN 'G1 - Minor storm'
    WHEN "Kp" < 7 THEN 'G2 - Moderate storm' WHEN "Kp" < 8 THEN 'G3 - Strong storm' WHEN "Kp" < 9 THEN 'G4 - Severe storm'
    ELSE 'G5 - Extreme storm' END"""


@query("kp_labels", f'SELECT series_id, time_tag, "Kp", {KP_SQL} AS label FROM kp')
def kp_labels(spark, sf_dir):
    return kp(spark, sf_dir).withColumn("label", d.kp_label("Kp"))


@query(
    "activity_and_flux",
    f"""SELECT series_id, time_tag, CASE WHEN ssn < 30 THEN 'Minimum' WHEN ssn < 80 THEN 'Rising / Declining'
    WHEN ssn < 140 THEN 'Moderate Maximum' ELSE 'High Maximum' END AS tier, {R('67 + 0.32e0 * ssn')} AS flux FROM monthly_by_nation""",
)
def activity_and_flux(spark, sf_dir):
    return monthly_by_nation(spark, sf_dir).select(
        "series_id", "time_tag", d.activity_tier("ssn").alias("tier"), r(d.flux_proxy("ssn")).alias("flux")
    )


@query(
    "cycle_position_and_weights",
    f"""SELECT series_id, {R('p')} AS pos, {R('greatest(0.2, least(2.0, 0.4e0 + 1.2e0 * p))')} AS modifier,
    {R('(1 - a) * 2 / 7', 3)} AS w_quiet, {R('(1 - a) * 5 / 7', 3)} AS w_moderate, {R('a', 3)} AS w_active FROM (
      SELECT *, 0.3e0 * greatest(0.2, least(2.0, 0.4e0 + 1.2e0 * p)) AS a FROM (
        SELECT series_id, greatest(0.0, least(1.0, (x - lo) / greatest(hi - lo, 1.0))) AS p FROM (
          SELECT series_id, arg_max(ssn, time_tag) AS x, min(CASE WHEN time_tag >= TIMESTAMP '1997-01-01' THEN ssn END) AS lo,
          max(CASE WHEN time_tag >= TIMESTAMP '1997-01-01' THEN ssn END) AS hi FROM monthly_by_nation GROUP BY 1)))""",
)
def cycle_position_and_weights(spark, sf_dir):
    late = F.col("time_tag") >= F.lit("1997-01-01").cast("timestamp_ntz")
    ends = monthly_by_nation(spark, sf_dir).groupBy("series_id").agg(
        F.max_by("ssn", "time_tag").alias("x"),
        F.min(F.when(late, F.col("ssn"))).alias("lo"),
        F.max(F.when(late, F.col("ssn"))).alias("hi"),
    )
    out = ends.withColumn("p", d.cycle_position("x", "lo", "hi")).withColumn("m", d.storm_rate_modifier("p"))
    w = d.adjusted_weights("m", {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.3})
    return out.select(
        "series_id",
        r("p").alias("pos"),
        r("m").alias("modifier"),
        w["Quiet"].alias("w_quiet"),
        w["Moderate"].alias("w_moderate"),
        w["Active"].alias("w_active"),
    )


@query(
    "time_from_day_of_year",
    "SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 5 HOUR AS at FROM orders",
)
def time_from_day_of_year(spark, sf_dir):
    o = F.col("o_orderdate")
    at = t.day_of_year_time(F.year(o), F.dayofyear(o), F.lit(5))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))


@query(
    "iso_format_and_age",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso,
    {R("(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0e0", 3)} AS age FROM events""",
)
def iso_format_and_age(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id", t.iso_time("ts").alias("iso"), r(t.age_hours(F.col("ts"), now), 3).alias("age")
    )


@query(
    "forecast_axis",
    """SELECT series_id, unnest(generate_series(m + INTERVAL 3 HOUR, m + INTERVAL 72 HOUR, INTERVAL 3 HOUR)) AS time_tag
    FROM (SELECT series_id, max(time_tag) AS m FROM ev3h_by_type GROUP BY 1)""",
)
def forecast_axis(spark, sf_dir):
    last = ev3h_by_type(spark, sf_dir).groupBy("series_id").agg(F.max("time_tag").alias("m"))
    return last.select("series_id", F.explode(t.time_axis(F.col("m"), "3 hours", 24)).alias("time_tag"))


@query(
    "mid_month_axis",
    """SELECT series_id, CAST(date_trunc('month', m) + to_months(CAST(i AS INTEGER)) + INTERVAL 14 DAY AS TIMESTAMP) AS time_tag FROM (
    SELECT series_id, max(time_tag) AS m FROM monthly_by_nation GROUP BY 1), range(1, 13) AS x(i)""",
)
def mid_month_axis(spark, sf_dir):
    last = monthly_by_nation(spark, sf_dir).groupBy("series_id").agg(F.max("time_tag").alias("m"))
    return last.select("series_id", F.explode(t.mid_month_axis(F.col("m"), 12)).alias("time_tag"))


@query(
    "blend_first_steps",
    f"""SELECT scenario, draw, step, {R('CASE step WHEN 0 THEN 0.8e0 * 4 + 0.2e0 * kp WHEN 1 THEN 0.4e0 * 4 + 0.6e0 * kp ELSE kp END')} AS kp FROM draws""",
)
def blend_first_steps(spark, sf_dir):
    from workload.series import draws

    mixed = d.blend_with_observed(F.col("step"), F.col("kp"), F.lit(4.0))
    return draws(spark, sf_dir).withColumn("kp", r(mixed))


@query(
    "elementary_functions",
    f"""SELECT event_id, {R('ln(1 + value)')} AS log1p, {R('exp(-value / 100)')} AS decay, {R('sqrt(value * value + 25)')} AS magnitude,
    {R('abs(value - 50)')} AS distance FROM events""",
)
def elementary_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        r(F.log1p(v)).alias("log1p"),
        r(F.exp(-v / 100)).alias("decay"),
        r(F.sqrt(v * v + 25)).alias("magnitude"),
        r(F.abs(v - 50)).alias("distance"),
    )
