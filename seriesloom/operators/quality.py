"""Data-quality checks: one aggregation over a table gives one row per check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names
from seriesloom.functions.timeaxis import age_hours

OK, WARNING, ERROR = "ok", "warning", "error"


@dataclass(frozen=True)
class Check:
    """``observed`` is an aggregate; ``passed`` a condition on aggregates, NULL counts as passed."""

    name: str
    observed: Column
    passed: Column
    limit: str
    severity: str = WARNING


def not_empty() -> Check:
    n = F.count(F.lit(1))
    return Check("not_empty", n, n > 0, "> 0", ERROR)


def min_rows(rows: int) -> Check:
    n = F.count(F.lit(1))
    return Check("min_rows", n, n >= rows, f">= {rows}", ERROR)


def fresh(time: str, now: Column, hours: float = 6.0) -> Check:
    age = age_hours(F.max(time), now)
    return Check("fresh", age, age <= hours, f"<= {hours:g} h")


def in_range(column: str, low: float, high: float) -> list[Check]:
    least, most = F.min(column), F.max(column)
    return [
        Check(f"{column}_min", least, least >= low, f">= {low:g}"),
        Check(f"{column}_max", most, most <= high, f"<= {high:g}"),
    ]


def not_all_null(columns: Sequence[str]) -> list[Check]:
    return [
        Check(f"{c}_present", F.count(c), F.count(c) > 0, "> 0", ERROR) for c in columns
    ]


def expected_events(years: int, test_share: float = 0.25, event_share: float = 0.08) -> Check:
    """Events to expect in the test part; a short training window gives too few for tight scores."""
    expected = F.floor(F.count(F.lit(1)) * test_share * event_share)
    return Check("expected_events", expected, F.lit(years >= 8), "years >= 8")


def results(checks: Sequence[Check]) -> Column:
    """All checks as one aggregate: an array of ``(check, status, observed, limit)``."""
    return F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check"),
                F.when(F.coalesce(c.passed, F.lit(True)), OK).otherwise(c.severity).alias("status"),
                c.observed.cast("double").alias("observed"),
                F.lit(c.limit).alias("limit"),
            )
            for c in checks
        ]
    )


def audit(df: DataFrame, checks: Sequence[Check], keys: str | Sequence[str] = ()) -> DataFrame:
    """Table ``(check, status, observed, limit)``, per key if given. Nothing is raised."""
    keys = names(keys)
    one = df.groupBy(*keys).agg(results(checks).alias("_results"))
    return one.select(*keys, F.explode("_results").alias("r")).select(*keys, "r.*")


def column_audit(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Required columns that the schema lacks, as audit rows; reads no data."""
    rows = [(c, OK if c in df.columns else ERROR) for c in wanted]
    return df.sparkSession.createDataFrame(rows, "check string, status string")
