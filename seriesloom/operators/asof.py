"""As-of lookups: each probe row takes a value from a history row near it in time.

Spark's DataFrame API has no as-of join. Both sides are put on one time axis and cut into
slices of time; inside a slice a running ``last`` finds the history row before or after each
probe. No pairs are formed, no task sees more than one slice of one series, and the result
does not depend on the slice length.

With ``span=None`` the slices follow the data (``slices.with_slices``): none holds more than
``rows`` rows of a series, however dense a burst is, and a table with the first and last history
row of every slice supplies what lies in another one. That is the plan for raw rows.

With a fixed span, which suits bucketed history, and a tolerance, history rows that lie within it of a slice boundary are copied into the
next slice as well, so one exchange of probes and history is all there is. Without one, the
nearest row may be any number of slices away; a table with the first and last history row of
every slice then supplies it.

History times must be unique within a series; use ``clean.dedupe`` first where they are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom._common import (
    floor_div,
    keyed,
    micros,
    names,
    over,
    require_utc,
    span_us,
    time_chunk,
)
from seriesloom.operators.slices import ROWS, with_slices

SPAN = "30 days"


def _point(at: Column, value: Column) -> Column:
    return F.struct(at.alias("at"), value.alias("value"))


def _axis(
    probes: DataFrame,
    marks: DataFrame,
    probe_time: str,
    keys: list[str],
    span: str | None,
) -> DataFrame:
    """Probes and marks as rows ``keys, _probe, <marks>, _us, _chunk, _side``.

    ``marks`` has the keys, its own columns, and ``_us`` and ``_chunk``. It sorts ahead of
    probes of the same time, as ``_side`` is true for probes.
    """
    carried = [c for c in probes.columns if c not in keys]
    chunk = [] if span is None else [keyed(time_chunk(probe_time, span), keys).alias("_chunk")]
    left = probes.select(
        *keys,
        F.struct(*carried).alias("_probe"),
        micros(probe_time).alias("_us"),
        *chunk,
        F.lit(True).alias("_side"),
    )
    return left.unionByName(marks.withColumn("_side", F.lit(False)), allowMissingColumns=True)


def _run(keys: list[str], column: str, falling: bool = False) -> Column:
    """The last value of ``column`` so far, along a slice or against it."""
    us = F.col("_us").desc() if falling else F.col("_us")
    w = over([*keys, "_chunk"], us, F.col("_side"))
    return F.last(column, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _history(history: DataFrame, time: str, value: str, keys: list[str], name: str) -> DataFrame:
    rows = history.where(F.col(time).isNotNull())
    return rows.select(
        *keys, _point(micros(time), F.col(value)).alias(name), micros(time).alias("_us")
    )


def _within_reach(rows: DataFrame, keys: list[str], span: str, back: int, ahead: int) -> DataFrame:
    """Copies of a row for every slice that has times up to ``back`` before or ``ahead`` after it."""
    size = span_us(span)
    low, high = (floor_div(F.col("_us") + F.lit(d), size) for d in (-back, ahead))
    return rows.withColumn("_chunk", F.explode(F.sequence(keyed(low, keys), high)))


def _answer(
    found: DataFrame, probes: DataFrame, keys: list[str], chosen: Column, keep: Column, name: str
) -> DataFrame:
    carried = [c for c in probes.columns if c not in keys]
    out = found.select(
        *keys,
        *[F.col("_probe")[c].alias(c) for c in carried],
        F.when(keep, chosen).alias("_hit"),
    )
    return out.select(*probes.columns, F.col("_hit.value").alias(name))


def _nearer() -> Column:
    down = F.col("_us") - F.col("_prev.at")
    up = F.col("_next.at") - F.col("_us")
    take_next = F.col("_prev").isNull() | (up <= down)
    return F.when(take_next, F.col("_next")).otherwise(F.col("_prev"))


def asof_nearest(
    probes: DataFrame,
    history: DataFrame,
    probe_time: str,
    history_time: str,
    value: str,
    name: str,
    keys: str | Sequence[str] = (),
    tolerance: str | None = None,
    span: str | None = SPAN,
    rows: int = ROWS,
) -> DataFrame:
    """Nearest history row in either direction; the later one when both are equally far.

    A distance equal to ``tolerance`` still counts. Without a tolerance every distance does.
    """
    require_utc(probes)
    keys = names(keys)
    points = _history(history, history_time, value, keys, "_hist")
    reach = None if tolerance is None else span_us(tolerance)
    if reach is None or span is None:
        found = _neighbours_at_any_distance(probes, points, probe_time, keys, span, rows)
        near = F.lit(True) if reach is None else F.abs(F.col("_us") - _nearer()["at"]) <= reach
        return _answer(found, probes, keys, _nearer(), near, name)
    axis = _axis(probes, _within_reach(points, keys, span, reach, reach), probe_time, keys, span)
    found = axis.select(
        "*", _run(keys, "_hist").alias("_prev"), _run(keys, "_hist", True).alias("_next")
    ).where("_side")
    near = F.abs(F.col("_us") - _nearer()["at"]) <= reach
    return _answer(found, probes, keys, _nearer(), near, name)


def asof_forward(
    probes: DataFrame,
    history: DataFrame,
    probe_time: str,
    history_time: str,
    value: str,
    name: str,
    keys: str | Sequence[str] = (),
    tolerance: str = "3 hours",
    span: str | None = SPAN,
    rows: int = ROWS,
) -> DataFrame:
    """First history row at or after the probe, or the last row for a probe past the end.

    The distance has to be smaller than ``tolerance``.
    """
    require_utc(probes)
    keys = names(keys)
    reach = span_us(tolerance)
    points = _history(history, history_time, value, keys, "_hist")
    if span is None:
        # Without a history row ahead, the last one of the series is the nearest one behind.
        found = _neighbours_at_any_distance(probes, points, probe_time, keys, None, rows)
        chosen = F.coalesce(F.col("_next"), F.col("_prev"))
        return _answer(found, probes, keys, chosen, F.abs(F.col("_us") - chosen["at"]) < reach, name)
    # Hash aggregation to one row per series: where its history ends.
    ends = points.groupBy(*keys).agg(
        F.max("_us").alias("_us"), F.max_by(F.col("_hist.value"), F.col("_us")).alias("_v")
    )
    ends = ends.where("_us is not null").select(
        *keys, _point(F.col("_us"), F.col("_v")).alias("_end"), "_us"
    )
    marks = _within_reach(points, keys, span, reach, 0).unionByName(
        _within_reach(ends, keys, span, 0, reach), allowMissingColumns=True
    )
    axis = _axis(probes, marks, probe_time, keys, span)
    found = axis.select(
        "*", _run(keys, "_end").alias("_prev"), _run(keys, "_hist", True).alias("_next")
    ).where("_side")
    chosen = F.coalesce(F.col("_next"), F.col("_prev"))
    return _answer(found, probes, keys, chosen, F.abs(F.col("_us") - chosen["at"]) < reach, name)


def _neighbours_at_any_distance(
    probes: DataFrame, points: DataFrame, probe_time: str, keys: list[str], span: str | None, rows: int
) -> DataFrame:
    if span is None:
        axis = with_slices(_axis(probes, points, probe_time, keys, None), keys, "_us", rows)
    else:
        axis = _axis(probes, _within_reach(points, keys, span, 0, 0), probe_time, keys, span)
    # Primitive aggregates only, so that this stays a hash aggregation.
    at, value = F.when(~F.col("_side"), F.col("_us")), F.col("_hist.value")
    slices = axis.groupBy(*keys, "_chunk").agg(
        F.min(at).alias("_a"),
        F.min_by(value, at).alias("_av"),
        F.max(at).alias("_z"),
        F.max_by(value, at).alias("_zv"),
    )
    first, last = (
        F.when(F.col(t).isNotNull(), _point(F.col(t), F.col(v))) for t, v in (("_a", "_av"), ("_z", "_zv"))
    )
    earlier = over(keys, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = over(keys, F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.select(
        *keys,
        "_chunk",
        F.last(last, ignorenulls=True).over(earlier).alias("_before"),
        F.last(first, ignorenulls=True).over(later).alias("_after"),
    )
    local = axis.select(
        "*", _run(keys, "_hist").alias("_lo"), _run(keys, "_hist", True).alias("_hi")
    ).where("_side")
    return local.join(edges, [*keys, "_chunk"], "left").withColumns(
        {"_prev": F.coalesce("_lo", "_before"), "_next": F.coalesce("_hi", "_after")}
    )


def recurrence_boost(
    looked_up: DataFrame, column: str, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Boost in 0..1 per series from the mean of the values found; 0 when none was found."""
    keys = names(keys)
    mean = F.avg(column)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - 3.0) / 4.0))
    boost = F.when(mean.isNull(), F.lit(0.0)).otherwise(scaled)
    return looked_up.groupBy(*keys).agg(F.count(column).alias("found"), boost.alias("boost"))
