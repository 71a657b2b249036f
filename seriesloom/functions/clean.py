"""Column expressions that clean values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom._common import col

# Tolerances of the "is close to" comparison of a value with a fill code.
ABSOLUTE_TOLERANCE = 1e-8
RELATIVE_TOLERANCE = 1e-5


def nan_to_null(value: str | Column) -> Column:
    return F.nanvl(col(value), F.lit(None).cast("double"))


def to_number(value: str | Column) -> Column:
    """Text to double; anything unreadable, and NaN, is NULL."""
    return nan_to_null(F.trim(col(value)).try_cast("double"))


def to_time(value: str | Column, strict: bool = False) -> Column:
    """Text to a UTC ``timestamp_ntz``; text with a zone offset is shifted to UTC.

    Unreadable text is NULL, or fails the job when ``strict``.
    """
    text = F.trim(col(value))
    parsed = text.cast("timestamp") if strict else text.try_cast("timestamp")
    wall = parsed.cast("timestamp_ntz")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":")
    return F.when(
        zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
    ).otherwise(wall)


def sentinel_to_null(value: str | Column, codes: Iterable[float]) -> Column:
    """NULL where the value is within tolerance of a fill code."""
    c = col(value)
    missing = F.lit(False)
    for code in codes:
        reach = ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(code)
        missing = missing | (F.abs(c - F.lit(float(code))) <= F.lit(reach))
    return F.when(~missing, c)


def clip(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range, NULL stays NULL."""
    c = out = col(value)
    if high is not None:
        out = F.least(F.lit(float(high)), out)
    if low is not None:
        out = F.greatest(F.lit(float(low)), out)
    return F.when(c.isNotNull(), out)


def finite_or_zero(value: str | Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    c = col(value)
    unusable = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(unusable, F.lit(0.0)).otherwise(c)
