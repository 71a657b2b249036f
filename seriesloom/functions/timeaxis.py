"""Column expressions on time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom._common import col, from_micros, micros, span_us

__all__ = [
    "age_hours",
    "bucket_start",
    "day_of_year_time",
    "iso_time",
    "mid_month_axis",
    "minute_floor",
    "month_index",
    "time_axis",
]


def bucket_start(time: str | Column, every: str) -> Column:
    """Left edge of the fixed-length bucket, counted from midnight UTC 1970-01-01."""
    us, width = micros(time), F.lit(span_us(every))
    return from_micros(us - F.pmod(us, width))


def minute_floor(time: str | Column) -> Column:
    return bucket_start(time, "1 minute")


def day_of_year_time(year: Column, day: Column, hour: Column) -> Column:
    """Time from year, 1-based day of year and hour; NULL outside the years 1 to 9999."""
    usable = F.when(year.between(1, 9999), year)
    first = F.try_make_timestamp_ntz(usable, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return first + F.make_dt_interval(day - 1, hour)


def month_index(time: str | Column, epoch_year: int = 1749) -> Column:
    """Whole months since January of the epoch year."""
    return (F.year(col(time)) - epoch_year) * 12 + (F.month(col(time)) - 1)


def iso_time(time: str | Column) -> Column:
    return F.date_format(col(time), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def age_hours(newest: Column, now: Column) -> Column:
    """Hours from the newest row to ``now``, which the caller passes so that runs repeat."""
    return (micros(now) - micros(newest)) / F.lit(3_600_000_000.0)


def time_axis(last: Column, every: str, steps: int) -> Column:
    """Array of the next ``steps`` times after ``last``."""
    width = span_us(every)
    return F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda i: from_micros(micros(last) + i.cast("long") * F.lit(width)),
    )


def mid_month_axis(last: Column, months: int) -> Column:
    """Array of day 15 of each of the next ``months`` months."""
    first = F.trunc(last.cast("date"), "month")
    return F.transform(
        F.sequence(F.lit(1), F.lit(months)),
        lambda i: F.date_add(F.add_months(first, i), 14).cast("timestamp_ntz"),
    )
