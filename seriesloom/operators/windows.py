"""Positional operators: row numbers, lags, fills and rolling statistics.

Each operator has two plans.

``span=None``
    One ordinary window per series. Right for bucketed frames, where a series has at most
    one row per bucket and so its length is bounded by the time range over the bucket width.

``span="7 days"``
    For raw series of any length, or for a single series. Rows are first numbered with
    :func:`number_rows`, which never puts more than one time slice of one series into a
    task. They are then cut into blocks of equal row counts, and each block also gets the
    few rows before and after it that its own rows look at. Results are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom._common import col, floor_div, keyed, names, over, require_utc, time_chunk

BLOCK_ROWS = 65_536


def number_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its series, without sorting a whole series in one task.

    ``chunk`` must not decrease along ``order`` (a time slice, a hash prefix). Positions are
    the local position in the chunk plus the rows in all earlier chunks; only the table of
    chunk counts, one row per series and chunk, is ever ordered as a whole.
    ``order`` has to be unique within a series for the numbering to be repeatable.

    The join at the end finds the rows already partitioned and sorted by series and chunk. It
    is a left join, because an inner one would filter out rows with a NULL key before the
    check for them.
    """
    keys = names(keys)
    cut = df.withColumn("_chunk", keyed(chunk, keys, chunk))
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *keys,
        "_chunk",
        (F.sum("_n").over(over(keys, "_chunk")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(over(keys)).alias("_total"),
    )
    local = cut.withColumn(
        "_local", F.row_number().over(over([*keys, "_chunk"], *[col(o) for o in order])) - 1
    )
    out = local.join(starts, [*keys, "_chunk"], "left")
    out = out.withColumn(name, F.col("_start") + F.col("_local"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, *[c for c in (name, total) if c])


FINER, LONGEST = 20, 1 << 46  # halvings below the even slice; microseconds, over two years


def even_span(
    df: DataFrame, keys: str | Sequence[str], time: str, rows: int = 500_000
) -> str:
    """The longest time slice, among powers of two, with at most ``rows`` rows of any series.

    Follows the densest place of the data, so a burst shortens the slices, down to a
    millionth of the slice that even data would have. Counts the rows of short slices, and
    longer ones from those counts. Runs two small jobs.
    """
    keys = names(keys)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if ends.n <= rows:
        return f"{LONGEST} microseconds"
    even = max(1, (ends.b - ends.a) * rows // ends.n)
    low = max(0, even.bit_length() - 1 - FINER)
    steps = LONGEST.bit_length() - 1 - low
    counts = df.groupBy(*keys, F.shiftright(at, low).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    longer = counts.withColumn("_up", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    longer = longer.groupBy(*keys, "_up", F.expr("shiftright(_slice, _up)").alias("_slice")).agg(F.sum("_n").alias("_n"))
    most = longer.groupBy("_up").agg(F.max("_n").alias("m")).collect()
    best = max([r["_up"] for r in most if r.m <= rows], default=0)
    return f"{1 << (low + best)} microseconds"


def _blocks(
    df: DataFrame,
    keys: list[str],
    time: str,
    span: str,
    before: int,
    after: int,
    block_rows: int,
) -> tuple[DataFrame, WindowSpec]:
    """Rows in blocks with their neighbours; ``_own`` marks the rows a block reports."""
    require_utc(df)
    numbered = number_rows(df, keys, [time], time_chunk(time, span), "_pos")
    pos = F.col("_pos")
    low = floor_div(F.greatest(pos - F.lit(after), F.lit(0)), block_rows)
    high = floor_div(pos + F.lit(before), block_rows)
    spread = numbered.withColumn("_block", F.explode(F.sequence(low, high)))
    spread = spread.withColumn("_own", F.col("_block") == floor_div(pos, block_rows))
    return spread, Window.partitionBy(*keys, "_block").orderBy("_pos")


def positional(
    df: DataFrame,
    exprs: Mapping[str, object],
    keys: str | Sequence[str],
    time: str,
    before: int = 0,
    after: int = 0,
    span: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``exprs`` maps a column name to a function from the window to a column.
    """
    keys = names(keys)
    if span is None:
        w = over(keys, time)
        return df.withColumns({n: f(w) for n, f in exprs.items()})
    spread, w = _blocks(df, keys, time, span, before, after, block_rows)
    done = spread.withColumns({n: f(w) for n, f in exprs.items()})
    return done.where("_own").drop("_pos", "_block", "_own")


def lags(
    df: DataFrame,
    shifts: Mapping[str, tuple[str, int]],
    keys: str | Sequence[str],
    time: str,
    span: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Row shifts ``{new: (column, rows)}``; negative rows look ahead.

    Positional: a bucket missing from the frame is not counted.
    See :func:`seriesloom.operators.resample.lookback_join` for shifts by time.
    """
    exprs = {n: (lambda w, c=c, k=k: F.lag(c, k).over(w)) for n, (c, k) in shifts.items()}
    reach = [k for _, k in shifts.values()]
    return positional(
        df, exprs, keys, time, max([0, *reach]), max([0, *[-k for k in reach]]), span, block_rows
    )


def rolling(
    df: DataFrame,
    column: str,
    rows: int,
    name: str,
    keys: str | Sequence[str],
    time: str,
    min_rows: int = 1,
    centred: bool = False,
    agg=F.avg,
    span: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing or centred statistic over ``rows`` rows, NULL below ``min_rows`` values."""
    after = rows // 2 if centred else 0
    before = rows - 1 - after

    def expr(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-before, after)
        return F.when(F.count(column).over(frame) >= min_rows, agg(column).over(frame))

    return positional(df, {name: expr}, keys, time, before, after, span, block_rows)


def ffill(
    df: DataFrame,
    columns: str | Sequence[str],
    keys: str | Sequence[str],
    time: str,
    span: str | None = None,
) -> DataFrame:
    """Replace NULLs by the last value before them.

    With ``span``, each time slice is filled on its own and takes its first value from a
    table of the last values of the slices before it.
    """
    keys, columns = names(keys), names(columns)

    def last_value(c: str, w: WindowSpec) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    if span is None:
        w = over(keys, time)
        return df.withColumns({c: last_value(c, w) for c in columns})
    require_utc(df)
    chunk = time_chunk(time, span)
    cut = df.withColumn("_chunk", keyed(chunk, keys, chunk))
    ends = cut.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns]
    )
    earlier = over(keys, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_chunk",
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
    )
    w = over([*keys, "_chunk"], time)
    filled = cut.withColumns({c: last_value(c, w) for c in columns})
    out = filled.join(carried, [*keys, "_chunk"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns})
    return out.select(*df.columns)


def lags_filled(
    df: DataFrame,
    column: str,
    shifts: Mapping[str, int],
    keys: str | Sequence[str],
    time: str,
    default: float,
) -> DataFrame:
    """Row lags of the filled column, filled again, with a default before the first value."""
    keys = names(keys)
    out = ffill(df, column, keys, time)
    out = lags(out, {n: (column, k) for n, k in shifts.items()}, keys, time)
    out = ffill(out, list(shifts), keys, time)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(float(default))) for n in shifts})


def tail_rows(df: DataFrame, rows: int, keys: str | Sequence[str], time: str) -> DataFrame:
    """The last ``rows`` rows of each series.

    Spark keeps only the best ``rows`` rows per key in each map task before it shuffles.
    """
    rank = F.row_number().over(over(names(keys), F.col(time).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= rows).drop("_rank")


def last_row(df: DataFrame, keys: str | Sequence[str], time: str) -> DataFrame:
    """The newest row of each series; the other columns decide between rows of the same time."""
    keys = names(keys)
    rest = [F.col(c).desc() for c in df.columns if c not in (*keys, time)]
    rank = F.row_number().over(over(keys, F.col(time).desc(), *rest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def index_fraction(
    df: DataFrame, keys: str | Sequence[str], time: str, span: str
) -> DataFrame:
    """Row index and its share of the series length, 0 to 1."""
    require_utc(df)
    out = number_rows(df, keys, [time], time_chunk(time, span), "row_index", total="_rows")
    share = F.col("row_index") / F.greatest(F.col("_rows") - 1, F.lit(1))
    return out.withColumn("row_fraction", share).drop("_rows")
