"""Summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom._common import col, join_same, names, over
from seriesloom.session import written

QUARTILES = (0.25, 0.5, 0.75)
SKETCH_ACCURACY = 10_000
#: Rows between the ends of a bracket that are put in order in one task; cells of a narrowing round.
MOST_INSIDE, CELLS = 1_000_000, 128


def _doubles(df: DataFrame, columns: Sequence[str], keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])


def _sketch(column: str, probs: Sequence[float], accuracy: int) -> list[Column]:
    """Row count and, for each quantile, a value a little below and one a little above it.

    The sketch is off by at most ``n / accuracy`` ranks, the values asked for by twice that.
    From ``2 * accuracy`` rows on they therefore enclose both neighbours of the quantile.
    Smaller groups are enclosed by their extremes.
    """
    margin = 2.0 / accuracy
    probes = [p for q in probs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    ends = F.array(*[f(column) for _ in probs for f in (F.min, F.max)])
    near = F.percentile_approx(column, probes, accuracy)
    n = F.count(column)
    bracket = F.when(n < 2 * accuracy, ends).otherwise(near)
    return [n.alias(f"_n_{column}"), bracket.alias(f"_s_{column}")]


def _unfold(df: DataFrame, keys: list[str], rows: Sequence[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def _placed(rows: DataFrame, brackets: DataFrame, columns: Sequence[str], keys: list[str]) -> DataFrame:
    """Rows with the brackets of their group."""
    if keys:
        return join_same(rows, brackets, keys)
    return rows.withColumn("_k", brackets.select(F.struct("*")).scalar()).select(*columns, "_k.*")


def _ends(c: str, i: int) -> tuple[Column, Column]:
    return F.col(f"_s_{c}")[2 * i], F.col(f"_s_{c}")[2 * i + 1]


def _narrowed(
    rows: DataFrame, brackets: DataFrame, targets: Sequence[tuple[str, int, float]], columns: Sequence[str],
    keys: list[str], most: int, accuracy: int,
) -> DataFrame:
    """Brackets with at most ``most`` rows strictly inside, and ``_below<j>``, the rows under them.

    A round counts, and sketches what is inside at ``CELLS`` evenly spaced places. A cell of the
    sketch holds a far larger share than the sketch can be off by, so the cells beside the one that
    holds the wanted rank enclose it, and a few hundredths of the rows are left after each round.
    Equal values are never split; they count as an end. Each round is written; the driver sees
    one number of it.
    """
    grid = [i / CELLS for i in range(CELLS + 1)]
    while True:
        placed = _placed(rows, brackets, columns, keys)
        aggs = [F.first(f"_n_{c}").alias(f"_n_{c}") for c in columns]
        aggs += [F.first(f"_s_{c}").alias(f"_s_{c}") for c in columns]
        for j, (c, i, _) in enumerate(targets):
            v, (lo, hi) = F.col(c), _ends(c, i)
            inside = (v > lo) & (v < hi)
            aggs += [
                F.count_if(v < lo).alias(f"_below{j}"),
                F.count_if(v == lo).alias(f"_at{j}"),
                F.count_if(inside).alias(f"_in{j}"),
                F.percentile_approx(F.when(inside, v), grid, accuracy).alias(f"_grid{j}"),
            ]
        counted = written(placed.groupBy(*keys).agg(*aggs), "brackets")
        left = F.greatest(*[F.col(f"_in{j}") for j in range(len(targets))], F.lit(0))
        if (counted.agg(F.max(left)).first()[0] or 0) <= most:
            return counted

        def ends_of(c: str, counted_targets: Sequence[tuple[int, int, float]]) -> Column:
            out = []
            for j, i, q in counted_targets:
                lo, hi = _ends(c, i)
                rank = F.floor((F.col(f"_n_{c}") - 1) * q) - F.col(f"_below{j}") - F.col(f"_at{j}")
                share = F.lit(CELLS) / F.greatest(F.col(f"_in{j}"), F.lit(1))
                first, last = (F.floor(rank * share) - 1).cast("int"), (F.ceil((rank + 2) * share) + 1).cast("int")
                some = F.col(f"_in{j}") > most
                out.append(F.when(some & (first >= 0), F.get(f"_grid{j}", F.least(first, F.lit(CELLS)))).otherwise(lo))
                out.append(F.when(some & (last <= CELLS), F.get(f"_grid{j}", F.greatest(last, F.lit(0)))).otherwise(hi))
            return F.array(*out)

        own = {c: [(j, i, q) for j, (d, i, q) in enumerate(targets) if d == c] for c in columns}
        narrower = [ends_of(c, own[c]).alias(f"_s_{c}") for c in columns]
        brackets = counted.select(*keys, *[f"_n_{c}" for c in columns], *narrower)


def _refine(
    rows: DataFrame, sketch: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: list[str],
    most: int = MOST_INSIDE, accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact quantiles from the sketch table ``keys, _n_<column>, _s_<column>``. Runs jobs."""
    targets = [(c, i, float(q)) for c in columns for i, q in enumerate(probs)]
    counted = _narrowed(rows, sketch, targets, columns, keys, most, accuracy)
    sides = _unfold(
        counted,
        keys,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(q).alias("prob"),
                F.col(f"_n_{c}").alias("_n"),
                F.col(f"_below{j}").alias("_below"),
            )
            for j, (c, _, q) in enumerate(targets)
        ],
    ).where("_n > 0")
    placed = _placed(rows, counted.select(*keys, *[f"_s_{c}" for c in columns]), columns, keys)
    hits = []
    for c, i, q in targets:
        v, (lo, hi) = F.col(c), _ends(c, i)
        hit = F.struct(F.lit(c).alias("column"), F.lit(q).alias("prob"), v.alias("value"))
        hits.append(F.when((v >= lo) & (v <= hi), hit))
    group = [*keys, "column", "prob"]
    # Filtered before it is unfolded: nearly all rows lie in no bracket.
    near = F.filter(F.array(*hits), lambda h: h.isNotNull())
    inside = placed.select(*keys, F.explode(near).alias("_r")).select(*keys, "_r.*")
    # Grouped by value first: a window then has at most ``most`` values and the two ends.
    inside = inside.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*group).orderBy("value")
    inside = inside.withColumn("_end", F.sum("_c").over(run))
    ranked = join_same(inside, sides, group)
    at = (F.col("_n") - 1) * F.col("prob")
    end, start = F.col("_end"), F.col("_end") - F.col("_c")

    def value_at(position: Column) -> Column:
        offset = position - F.col("_below")
        found = F.max(F.when((start <= offset) & (offset < end), F.col("value")))
        return F.coalesce(found, F.raise_error(F.lit("quantile outside its bracket")).cast("double"))

    picked = ranked.groupBy(*group).agg(
        F.first(at - F.floor(at)).alias("_part"),
        value_at(F.floor(at)).alias("_a"),
        value_at(F.ceil(at)).alias("_z"),
    )
    step = F.col("_z") - F.col("_a")
    return picked.select(*group, (F.col("_a") + step * F.col("_part")).alias("quantile"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    keys: str | Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
    most: int = MOST_INSIDE,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per key, column and ``prob``.

    Spark's exact ``percentile`` gathers all distinct values of a group in one task. Here a
    mergeable sketch first gives, for each quantile, two values that enclose it, with a share
    of about ``4 / accuracy`` of the rows between them. While more than ``most`` rows of any group
    lie between, another round narrows the brackets; what is left is grouped by value and put in
    order. The answer is exact, and no task orders more than ``most`` values. Runs a job per round.
    """
    keys = names(keys)
    rows = _doubles(df, columns, keys)
    sketch = rows.groupBy(*keys).agg(*[a for c in columns for a in _sketch(c, probs, accuracy)])
    return _refine(rows, sketch, columns, probs, keys, most, accuracy)


def describe(df: DataFrame, columns: Sequence[str], keys: str | Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column.

    Statistics and sketches come from one pass, which is run and written here, as the counts
    below the brackets and the rows inside them both need its result.
    """
    keys = names(keys)
    by = [*keys, "column"]
    rows = _doubles(df, columns, keys)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = rows.groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in stats.items()],
        *[a for c in columns for a in _sketch(c, QUARTILES, SKETCH_ACCURACY)],
    )
    wide = written(wide, "statistics")
    base = _unfold(
        wide,
        keys,
        [F.struct(F.lit(c).alias("column"), *[F.col(f"_{n}_{c}").alias(n) for n in stats]) for c in columns],
    )
    sketch = wide.select(*keys, *[f"_{x}_{c}" for c in columns for x in ("n", "s")])
    quartiles = _refine(rows, sketch, columns, QUARTILES, keys).groupBy(*by).agg(
        *[
            F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(n)
            for q, n in zip(QUARTILES, ("p25", "p50", "p75"))
        ]
    )
    out = join_same(base, quartiles, by, "left")
    return out.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, with the row count, in one pass over the table."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]
    return one.select(F.col("_rows").alias("rows"), F.explode(F.array(*pairs)).alias("p")).select(
        "p.column", "p.nulls", "rows"
    )


def time_range(df: DataFrame, time: str, keys: str | Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def spread(df: DataFrame, column: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """Mean, extremes and population deviation."""
    return df.groupBy(*names(keys)).agg(
        F.avg(column).alias("mean"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.stddev_pop(column).alias("std_pop"),
    )


def standardise(
    df: DataFrame, columns: Sequence[str], keys: str | Sequence[str] = ()
) -> DataFrame:
    """Columns shifted to mean 0 and scaled by their population deviation; a constant becomes 0."""
    keys = names(keys)
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_d_{c}") for c in columns]
    )
    if keys:
        placed = join_same(df, moments, keys)
    else:
        placed = df.withColumn("_k", moments.select(F.struct("*")).scalar()).select(*df.columns, "_k.*")
    scale = {c: F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(F.lit(1.0)) for c in columns}
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in columns}
    return placed.withColumns(scaled).select(*df.columns)


def condition_share(
    df: DataFrame, conditions: dict[str, Column], keys: str | Sequence[str] = ()
) -> DataFrame:
    """How many rows meet each condition, and which share of all rows that is."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, condition in conditions.items():
        hits = F.count_if(condition)
        aggs += [hits.alias(f"{name}_rows"), (hits / F.count(F.lit(1))).alias(f"{name}_share")]
    return df.groupBy(*names(keys)).agg(*aggs)


def peak_row(df: DataFrame, value: str, time: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """Largest value of each series and its time; the earliest one on a tie."""
    keys = names(keys)
    known = df.where(F.col(value).isNotNull())
    rank = F.row_number().over(over(keys, F.col(value).desc(), F.col(time)))
    best = known.select(*keys, time, value, rank.alias("_rank")).where("_rank = 1")
    return best.select(*keys, F.col(time).alias("peak_time"), F.col(value).alias("peak_value"))


def row_mean(*columns: str | Column) -> Column:
    """Mean across columns of the values that are present."""
    cs = [col(c) for c in columns]
    zero = F.lit(0.0)
    total = sum([F.coalesce(c, zero) for c in cs], zero)
    present = sum([c.isNotNull().cast("int") for c in cs], F.lit(0))
    return F.when(present > 0, total / present)


def ranked(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows by falling value, names breaking ties."""
    return df.orderBy(F.col(value).desc(), F.col(name))
