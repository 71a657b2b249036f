"""Slices of time that follow the data: none holds more than a given number of rows of a series.

Rows are counted in cells of one width; only cells with too many rows are counted again in finer ones.
Neighbouring cells are then put together up to the bound. What a row needs to find its slice is one
small row per series and cell, with the places inside the cell where a new slice begins; its own
place among them is found by binary search in a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import keyed, names, over
from seriesloom.session import written

ROWS, FINER, WIDEST = 500_000, 6, 46  # rows of a slice; halvings per round; 2 ** 46 us are over two years


def bisect(values: str | Column, x: Column, most: int = 20) -> Column:
    """How many values of a sorted array, of up to ``2 ** most`` values, are not above ``x``."""
    values = F.col(values) if isinstance(values, str) else values
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= x, at + step).otherwise(at)
    )


def split_points(
    df: DataFrame, keys: str | Sequence[str], us: str, rows: int = ROWS
) -> tuple[DataFrame, int] | None:
    """(``keys, _cell, _starts, _slices``, bits): where slices begin inside each cell of ``2 ** bits``.

    ``us`` names a column of microseconds. None where the whole table fits one slice. Rows of one
    series and one microsecond stay together, however many they are. Runs a job for the extent and
    one per width; the driver gets a few numbers.
    """
    keys = names(keys)
    ends = df.agg(F.min(us).alias("a"), F.max(us).alias("z"), F.count(F.lit(1)).alias("n")).first()
    if ends.n <= rows:
        return None
    half = max(1, rows // 2)
    even = max(1, (ends.z - ends.a) * half // (2 * ends.n))
    bits = base = min(WIDEST, even.bit_length() - 1)
    left, cells = df.select(*keys, us), []
    while True:
        at = F.shiftright(us, bits)
        # Written, as the cells, the rows of the next round and its counts all come from it.
        counts = written(left.groupBy(*keys, at.alias("_at")).agg(F.count(F.lit(1)).alias("_n")), "cells")
        fits = F.col("_n") <= (half if bits else ends.n)
        cells.append(counts.where(fits).select(*keys, F.shiftleft("_at", bits).alias("_start"), "_n"))
        heavy = counts.where(~fits).select(*keys, "_at")
        if not bits or heavy.isEmpty():
            break
        left = df.select(*keys, us).withColumn("_at", at).join(heavy, [*keys, "_at"], "left_semi").drop("_at")
        bits = max(0, bits - FINER)
    every = reduce(DataFrame.unionByName, cells)
    # A slice is begun by the first cell that ends its half: cells add at most another half to it.
    before = F.sum("_n").over(over(keys, "_start")) - F.col("_n")
    sliced = every.withColumn("_slice", F.floor(before / half))
    cell = F.shiftright("_start", base).alias("_cell")
    begins = sliced.groupBy(*keys, cell, "_slice").agg(F.min("_start").alias("_start"))
    listed = begins.groupBy(*keys, "_cell").agg(F.array_sort(F.collect_list(F.struct("_start", "_slice"))).alias("_l"))
    return listed.select(*keys, "_cell", F.col("_l._start").alias("_starts"), F.col("_l._slice").alias("_slices")), base


def with_slices(
    df: DataFrame, keys: str | Sequence[str], us: str, rows: int = ROWS, name: str = "_chunk"
) -> DataFrame:
    """Add ``name``, which rises with time and is the same for at most ``rows`` rows of a series."""
    keys = names(keys)
    found = split_points(df, keys, us, rows)
    if found is None:
        return df.withColumn(name, keyed(F.lit(0).cast("long"), keys))
    table, bits = found
    placed = df.withColumn("_cell", keyed(F.shiftright(us, bits), keys)).join(table, [*keys, "_cell"], "left")
    at = F.when(F.size("_starts") == 1, F.lit(1)).otherwise(bisect("_starts", F.col(us)))
    return placed.withColumn(name, F.element_at("_slices", at)).select(*df.columns, name)
