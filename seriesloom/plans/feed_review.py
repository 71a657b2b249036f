"""Review of landed feeds: completeness, ranges, summaries and the joined table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names
from seriesloom.operators.stats import describe


def completeness(feeds: Mapping[str, DataFrame], time: str = "time_tag") -> DataFrame:
    """Per feed: rows, cells, NULL cells and time range, one pass over each."""
    parts = []
    for name, df in feeds.items():
        values = [c for c in df.columns if c != time]
        nulls = sum([F.count_if(F.col(c).isNull()) for c in values], F.lit(0).cast("long"))
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("rows"),
                (F.count(F.lit(1)) * len(values)).alias("cells"),
                nulls.alias("null_cells"),
                F.min(time).alias("first_time"),
                F.max(time).alias("last_time"),
            ).select(F.lit(name).alias("feed"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def summaries(feeds: Mapping[str, DataFrame], time: str = "time_tag") -> DataFrame:
    parts = []
    for name, df in feeds.items():
        values = [c for c in df.columns if c != time]
        parts.append(describe(df, values).select(F.lit(name).alias("feed"), "*"))
    return reduce(DataFrame.unionByName, parts)


def aligned(
    feeds: Sequence[DataFrame], keys: str | Sequence[str] = (), time: str = "time_tag"
) -> DataFrame:
    """Rows for the times that all feeds share."""
    on = [*names(keys), time]
    return reduce(lambda left, right: left.join(right, on), feeds)
