"""Whole runs: from tables to one result document per series. Both run jobs for the fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import series_keys
from seriesloom.config import SeasonalConfig, StormConfig
from seriesloom.functions.domain import kp_label
from seriesloom.functions.timeaxis import iso_time
from seriesloom.operators import ensemble, quality
from seriesloom.operators import model as m
from seriesloom.operators.windows import last_row
from seriesloom.plans import seasonal, storm_forecast, storm_frames
from seriesloom.session import written
from seriesloom.sources.documents import forecast_arrays, ordered_array


#: Fewer rows are too few to learn from.
MIN_TRAINING_ROWS = 32


def _fields(df: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*columns).alias(name))


def _combine(parts: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """One row per series of the first part; the others add what they have of it."""
    return reduce(lambda left, right: left.join(right, keys, "left"), parts)


def _or_archive(first: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``archive`` for series that ``first`` does not have."""
    missing = archive.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.select(*archive.columns).unionByName(missing)


def seasonal_report(
    monthly: DataFrame,
    keys: str | Sequence[str],
    config: SeasonalConfig,
    source: str,
    storm: StormConfig | None = None,
    time: str = "time_tag",
) -> DataFrame:
    """Metrics, current level, cycle phase, forecast and scenario weights of every series."""
    keys = series_keys(keys)
    rows = written(seasonal.from_year(monthly, config.start_year, time).select(*keys, time, "ssn"), "monthly")
    model, test = seasonal.train_seasonal(rows, keys, config, time)
    ahead = written(seasonal.forecast_months(model, rows, keys, config, time), "months-ahead")
    phase = seasonal.cycle_phase(rows, ahead, keys, config, time)
    weights = seasonal.recommended_weights(phase, keys, storm).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", "weight")))).alias(
            "recommended_scenario_weights"
        )
    )
    current = last_row(rows, keys, time).select(
        *keys, iso_time(time).alias("time"), F.bround("ssn", 1).alias("ssn_monthly")
    )
    arrays = ahead.groupBy(*keys).agg(
        ordered_array("step", iso_time(time)).alias("times"),
        ordered_array("step", F.bround("ssn", 1)).alias("ssn_predicted"),
    )
    level = ["current_smooth_ssn", "f107_proxy", "solar_activity_tier"]
    cycle = ["ssn_normalized", "cycle_min_ssn", "cycle_max_observed_ssn"]
    integration = ["storm_rate_modifier", "f107_proxy", "ssn_normalized", "recommended_scenario_weights"]
    parts = [
        rows.groupBy(*keys).agg(F.lit(source).alias("source"), F.count("ssn").alias("data_months")),
        _fields(seasonal.seasonal_scores(test, keys), keys, "metrics"),
        _fields(current.join(phase.select(*keys, *level), keys, "left"), keys, "current"),
        _fields(phase, keys, "cycle_phase", cycle),
        _fields(arrays, keys, "forecast"),
        _fields(phase.join(weights, keys, "left"), keys, "integration", integration),
    ]
    return _combine(parts, keys)


def storm_checks(now: Column, time: str = "time_tag") -> dict[str, list[quality.Check]]:
    """Checks of the live feeds and of the rows that the model learns from, by table."""
    always = [quality.not_empty(), quality.fresh(time, now)]
    training = [quality.min_rows(MIN_TRAINING_ROWS), *quality.in_range("Kp", 0, 9.5)]
    return {
        "plasma": [*always, *quality.in_range("speed", 100, 2000)],
        "mag": always,
        "kp": always,
        "archive": training,
    }


def storm_report(
    plasma: DataFrame,
    mag: DataFrame,
    kp: DataFrame,
    hourly: DataFrame,
    scenarios: DataFrame,
    draws: DataFrame,
    keys: str | Sequence[str],
    config: StormConfig,
    sources: Mapping[str, str],
    weights: ensemble.Weights | None = None,
    time: str = "time_tag",
    now: Column | None = None,
) -> DataFrame:
    """Audit, metrics, newest prediction and scenario forecast of every series.

    ``scenarios`` and ``draws`` are long tables of step inputs, the latter with a ``draw``.
    Series without live rows fall back to the archive. The model is pooled, its scores are
    per series. ``audit`` holds what the ``storm_checks`` of each table say about the series, as
    of ``now`` (else the current time); ``archive`` there means the rows to learn from. A series
    that a table doesn't have fails ``not_empty`` there. Checks are made by the aggregations that
    count the rows.
    """
    keys = series_keys(keys)
    checks = storm_checks(F.localtimestamp() if now is None else now, time)
    weights = weights if weights is not None else config.weights
    # The archive is read once; everything after it works on its 3-hour means.
    means = written(storm_frames.bucket_means(hourly, keys, time, "kp"), "archive-means")
    history = means.select(*keys, time, "Kp")
    frame = written(storm_frames.frame_of_means(means, keys, time), "archive-frame")
    live = written(storm_frames.live_frame(plasma, mag, kp, history, keys, time), "live-frame")
    model, test = storm_forecast.train_storm(frame, keys, config, time)

    observed = _or_archive(kp.select(*keys, time, "Kp"), history, keys)
    newest = _or_archive(live, frame.drop("Kp"), keys)
    latest = m.score_latest(model, newest, keys, time, 0.0, 9.0)
    seen = last_row(observed, keys, time).select(*keys, F.col("Kp").alias("observed_kp"))
    latest = latest.select(
        *keys,
        iso_time(time).alias("time"),
        F.col("prediction").alias("predicted_kp"),
        kp_label("prediction").alias("category"),
    ).join(seen, keys, "left")

    def forecast(table: DataFrame, trajectory: Sequence[str], label: str) -> DataFrame:
        scored = storm_forecast.forecast_storms(
            model, table, observed, history, keys, config.steps, trajectory, time
        )
        return written(scored, label)

    paths = forecast(scenarios, ["scenario"], "paths")
    members = forecast(draws, ["scenario", "draw"], "members")
    weighted = ensemble.weighted_by_step(paths, "kp", weights, [*keys, "step", time])
    chance = ensemble.exceedance_by_step(members, "kp", weights, keys=keys)
    by_step = weighted.withColumnRenamed("kp", "kp_weighted").join(
        chance.withColumnRenamed("probability", "storm_prob_per_window"), [*keys, "step"], "left"
    )
    outlook = by_step.groupBy(*keys).agg(
        F.avg("kp_weighted").alias("mean_weighted_kp"),
        F.max("kp_weighted").alias("peak_weighted_kp"),
        F.avg("storm_prob_per_window").alias("storm_probability_windows"),
    )
    whole = storm_forecast.storm_outlook(members, weights, keys)
    outlook = outlook.join(
        whole.select(*keys, (F.col("probability") * 100).alias("storm_prob_pct"), "standard_error"), keys, "left"
    )
    parts = [
        frame.select(*keys).distinct(),
        _audited({"plasma": plasma, "mag": mag, "kp": kp, "archive": frame}, checks, keys),
        _fields(storm_forecast.storm_scores(test, keys), keys, "metrics"),
        _fields(latest, keys, "latest"),
        forecast_arrays(paths, by_step, keys, "kp"),
        _fields(outlook, keys, "outlook"),
    ]
    named = F.struct(*[F.lit(v).alias(k) for k, v in sources.items()]).alias("sources")
    out = _combine(parts, keys)
    return out.select(*keys, named, "counts", "audit", "metrics", "latest", "forecast", "outlook")


def _audited(
    tables: Mapping[str, DataFrame], checks: Mapping[str, Sequence[quality.Check]], keys: list[str]
) -> DataFrame:
    """Row counts and check results of every series, one aggregation per table."""
    counted = [
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), quality.results(checks[name]).alias("_results"))
        .withColumn("_of", F.lit(name))
        for name, df in tables.items()
    ]
    none = quality.not_empty()
    missing = F.array(
        F.struct(
            F.lit(none.name).alias("check"),
            F.lit(none.severity).alias("status"),
            F.lit(0.0).alias("observed"),
            F.lit(none.limit).alias("limit"),
        )
    )

    def of(name: str, column: str) -> Column:
        return F.any_value(F.when(F.col("_of") == name, F.col(column)), True)

    def rows(name: str) -> Column:
        return F.transform(
            F.coalesce(f"_{name}", missing),
            lambda r: F.struct(F.lit(name).alias("feed"), *[r[c].alias(c) for c in ("check", "status", "observed", "limit")]),
        )

    one = reduce(DataFrame.unionByName, counted).groupBy(*keys).agg(
        F.struct(*[F.coalesce(of(n, "_n"), F.lit(0)).alias(f"{n}_rows") for n in tables]).alias("counts"),
        *[of(n, "_results").alias(f"_{n}") for n in tables],
    )
    return one.select(*keys, "counts", F.concat(*[rows(n) for n in tables]).alias("audit"))
