"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def names(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def series_keys(value: str | Iterable[str]) -> list[str]:
    """Keys of an operator that joins tables of series, which takes at least one."""
    keys = names(value)
    if not keys:
        raise ValueError("name at least one key column; a single series needs a constant one")
    return keys


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def span_us(text: str) -> int:
    """Length of an interval text such as ``3 hours`` in microseconds."""
    return int(pd.Timedelta(text).value // 1000)


def interval(text: str) -> Column:
    """The same interval text as a Spark literal, calendar units included."""
    return F.expr(f"INTERVAL '{text}'")


def micros(time: str | Column) -> Column:
    """Microseconds since 1970 of a UTC timestamp of either type."""
    return F.unix_micros(col(time).cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def floor_div(value: Column, size: int) -> Column:
    """Whole-number division that rounds down, without a detour over doubles."""
    divisor = F.lit(size).cast("long")
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def time_chunk(time: str | Column, span: str) -> Column:
    """Index of the fixed-length slice of time that a row falls in."""
    return floor_div(micros(time), span_us(span))


def keyed(value: Column, keys: Sequence[str], *more: Column) -> Column:
    """``value``, or a failed job where a key is NULL: such a row belongs to no series, and
    the joins of the series operators would lose it without a word."""
    parts = [*[F.col(k) for k in keys], *more]
    if not parts:
        return value
    unusable = parts[0].isNull()
    for part in parts[1:]:
        unusable = unusable | part.isNull()
    message = F.lit("series operators need keys and order columns without NULL")
    return F.when(unusable, F.raise_error(message).cast("long")).otherwise(value)


def require_utc(df: DataFrame) -> None:
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"session time zone is {zone}; set spark.sql.session.timeZone to UTC")


def over(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spec.orderBy(*order) if order else spec


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns in which NULL keys match, keeping the left copy of the keys.

    For tables of groups, whose keys may be NULL. A plain ``join`` is better between series:
    it can reuse the partitioning of a window or an aggregation on the same keys.
    """
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") for c in on],
        *[c for c in right.columns if c not in on],
    )
    condition = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])
