"""Row-level cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import col, names, over
from seriesloom.functions.clean import sentinel_to_null


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def null_sentinels(df: DataFrame, codes: Mapping[str, Iterable[float]]) -> DataFrame:
    """Replace fill codes by NULL, within tolerance, in the named columns."""
    require_columns(df, codes)
    return df.withColumns({c: sentinel_to_null(c, values) for c, values in codes.items()})


def dedupe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct combination of ``columns``; rows that differ in any of them survive."""
    return df.select(*columns).distinct()


def dedupe(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str | Column],
    keep: str = "first",
) -> DataFrame:
    """One row per ``keys``: the first or last by ``order``.

    Spark applies the rank limit in every map task before it shuffles, so a key with very many
    copies sends one row per task.
    """
    keys = names(keys)
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    order = [col(o) for o in order]
    # All remaining columns end the ordering, so that ties give the same row on every run.
    order += [F.col(c) for c in df.columns if c not in keys]
    if keep == "last":
        order = [o.desc() for o in order]
    rank = F.row_number().over(over(keys, *order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
