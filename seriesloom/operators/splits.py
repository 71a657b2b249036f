"""Time-ordered splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names, require_utc, time_chunk
from seriesloom.operators.windows import number_rows


def time_split(
    df: DataFrame,
    fraction: float,
    keys: str | Sequence[str],
    time: str,
    min_train: int = 1,
    min_test: int = 1,
    span: str = "365 days",
) -> DataFrame:
    """Add ``is_train``: true for the first ``int(fraction * n)`` rows of each series.

    The cut leaves at least ``min_train`` rows before it and ``min_test`` after it.
    """
    require_utc(df)
    out = number_rows(df, keys, [time], time_chunk(time, span), "_pos", total="_rows")
    cut = F.floor(F.lit(fraction) * F.col("_rows"))
    cut = F.greatest(F.lit(min_train), F.least(cut, F.col("_rows") - min_test))
    return out.withColumn("is_train", F.col("_pos") < cut).drop("_pos", "_rows")


MIN_TRAIN, MIN_TEST = 10, 5


def numbered(
    df: DataFrame,
    keys: str | Sequence[str],
    time: str,
    max_rows: int | None = None,
    span: str = "365 days",
) -> DataFrame:
    """Add ``_pos`` (from 0) and ``_rows`` of each series, which place every fold, and ``_all``.

    ``max_rows`` keeps the end of each series and counts from there; ``_all`` is the number of
    rows before that, which decides whether a series is long enough.
    """
    require_utc(df)
    out = number_rows(df, names(keys), [time], time_chunk(time, span), "_pos", total="_rows")
    out = out.withColumn("_all", F.col("_rows"))
    if max_rows is not None:
        skipped = F.greatest(F.col("_rows") - max_rows, F.lit(0))
        out = out.withColumns({"_pos": F.col("_pos") - skipped, "_rows": F.col("_rows") - skipped})
        out = out.where("_pos >= 0")
    return out


def fold_parts(
    fold: Column,
    folds: int,
    gap: int,
    min_rows: int | None = None,
    min_train: int = MIN_TRAIN,
    min_test: int = MIN_TEST,
) -> tuple[Column, Column]:
    """(in training, in test) of a fold for rows of ``numbered``; neither where the series is too
    short for the fold."""
    least = 32 * folds if min_rows is None else min_rows
    size = F.floor(F.col("_rows") / (folds + 1))
    first = F.col("_rows") - (F.lit(folds) - fold) * size
    usable = (F.col("_all") >= least) & (first - gap >= min_train) & (size >= min_test)
    in_train = usable & (F.col("_pos") < first - gap)
    in_test = usable & (F.col("_pos") >= first) & (F.col("_pos") < first + size)
    return in_train, in_test


def expanding_folds(
    df: DataFrame,
    folds: int,
    gap: int,
    keys: str | Sequence[str],
    time: str,
    max_rows: int | None = None,
    min_rows: int | None = None,
    span: str = "365 days",
    min_train: int = MIN_TRAIN,
    min_test: int = MIN_TEST,
) -> DataFrame:
    """One copy of a row for each fold it takes part in, with ``fold`` and ``is_train``.

    Fold ``k`` tests the ``k``-th of ``folds`` equal stretches at the end of a series and
    trains on everything before it but the last ``gap`` rows. Series shorter than
    ``min_rows`` take no part (32 rows per fold unless given), nor do folds with fewer than
    ``min_train`` training or ``min_test`` test rows; ``fold_status`` lists both.
    ``max_rows`` restricts the folds to the end of each series.
    """
    out = numbered(df, keys, time, max_rows, span)
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    in_train, in_test = fold_parts(F.col("fold"), folds, gap, min_rows, min_train, min_test)
    out = out.where(in_train | in_test).withColumn("is_train", in_train)
    return out.drop("_pos", "_rows", "_all")


def fold_status(
    df: DataFrame,
    folds: int,
    gap: int,
    keys: str | Sequence[str],
    min_rows: int | None = None,
    min_train: int = MIN_TRAIN,
    min_test: int = MIN_TEST,
    max_rows: int | None = None,
) -> DataFrame:
    """``keys, rows, folds, status``: how many folds each series takes part in."""
    least = 32 * folds if min_rows is None else min_rows
    counts = df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("rows"))
    used_rows = F.col("rows") if max_rows is None else F.least("rows", F.lit(max_rows))
    size = F.floor(used_rows / (folds + 1))
    fits = lambda k: (used_rows - (F.lit(folds) - k) * size - gap >= min_train) & (size >= min_test)
    used = F.size(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), fits)).cast("long")
    used = F.when(F.col("rows") >= least, used).otherwise(F.lit(0).cast("long"))
    status = F.when(used == folds, "ok").when(used > 0, "some folds").otherwise("left out")
    return counts.withColumn("folds", used).withColumn("status", status)
