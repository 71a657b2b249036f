"""Forecast verification. Every score is an aggregation over ``(observed, forecast)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom._common import col, join_same, names
from seriesloom.operators.windows import lags


def mae(y: str | Column, p: str | Column) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def r2(y: str | Column, p: str | Column) -> Column:
    """1 - residual over total sum of squares, in one pass; NULL for constant observations."""
    both = col(y).isNotNull() & col(p).isNotNull()
    observed = F.when(both, col(y))
    residual = F.sum(F.pow(col(y) - col(p), F.lit(2.0)))
    total = F.var_pop(observed) * F.count(observed)
    return F.lit(1.0) - F.when(total > 0, residual / total)


def regression_scores(
    df: DataFrame, y: str, p: str, keys: str | Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    return df.groupBy(*names(keys)).agg(
        F.count(F.lit(1)).alias(f"{prefix}rows"),
        mae(y, p).alias(f"{prefix}mae"),
        r2(y, p).alias(f"{prefix}r2"),
    )


def with_train_mean(
    split: DataFrame, y: str, name: str, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Test rows with the training mean of their series (or of all rows, without keys)."""
    keys = names(keys)
    train, test = split.where("is_train"), split.where("not is_train")
    if not keys:
        return test.withColumn(name, train.agg(F.avg(y)).scalar())
    return join_same(test, train.groupBy(*keys).agg(F.avg(y).alias(name)), keys, "left")


def skill(df: DataFrame, score: str = "mae", reference: str = "persistence_mae",
          baseline: str = "baseline_mae") -> DataFrame:
    """Ratio to the persistence error and percentage gained over the baseline error."""
    ratio = F.when(F.col(reference) > 0, F.col(score) / F.col(reference))
    gain = F.when(F.col(baseline) > 0, 100.0 * (1.0 - F.col(score) / F.col(baseline)))
    return df.withColumns({"skill_ratio": ratio, "improvement_pct": gain})


def contingency(
    df: DataFrame, y: str, p: str, threshold: float, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Event table at a threshold with critical success index (0 when there were no events),
    probability of detection and false-alarm ratio."""
    seen, said = col(y) >= threshold, col(p) >= threshold
    counts = df.groupBy(*names(keys)).agg(
        F.count_if(seen & said).alias("tp"),
        F.count_if(~seen & said).alias("fp"),
        F.count_if(seen & ~said).alias("fn"),
        F.count_if(~seen & ~said).alias("tn"),
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    events = tp + fp + fn
    return counts.withColumns(
        {
            "csi": F.when(events > 0, tp / events).otherwise(F.lit(0.0)),
            "pod": F.try_divide(tp, tp + fn),
            "far": F.try_divide(fp, tp + fp),
        }
    )


def regime_scores(
    df: DataFrame, y: str, p: str, threshold: float, keys: str | Sequence[str] = ()
) -> DataFrame:
    regime = F.when(col(y) >= threshold, "storm").otherwise("quiet").alias("regime")
    return df.groupBy(*names(keys), regime).agg(
        F.count(F.lit(1)).alias("rows"), mae(y, p).alias("mae")
    )


def residual_spread(df: DataFrame, y: str, p: str, keys: str | Sequence[str] = ()) -> DataFrame:
    residual = col(y) - col(p)
    return df.groupBy(*names(keys)).agg(
        F.avg(residual).alias("mean_residual"), F.stddev_pop(residual).alias("std_residual")
    )


def histogram(
    df: DataFrame, value: str | Column, bins: int, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value of each series.

    The last bin includes its right edge; a constant series gets a range of width 1.
    """
    keys = names(keys)
    rows = df.select(*keys, col(value).alias("_v")).where("_v is not null")
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if keys:
        rows = join_same(rows, ends, keys)
    else:
        ends = ends.select(F.struct("_lo", "_hi").alias("e")).scalar()
        rows = rows.withColumn("_e", ends).select("_v", "_e._lo", "_e._hi")
    flat = F.col("_lo") == F.col("_hi")
    rows = rows.withColumns(
        {
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.floor((F.col("_v") - F.col("_lo")) / width)
    binned = rows.withColumn("bin", F.least(index, F.lit(bins - 1)))
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.col("_lo") + F.col("bin") * width).alias("left_edge"),
    )


def reliability(
    df: DataFrame, probability: str, outcome: Column, bins: int = 10, keys: str | Sequence[str] = ()
) -> DataFrame:
    """Mean forecast probability against observed frequency in equal-width probability bins."""
    index = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(*names(keys), index).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(probability).alias("mean_forecast"),
        F.avg(outcome.cast("double")).alias("observed_frequency"),
    )


def diebold_mariano(
    df: DataFrame,
    y: str,
    first: str,
    second: str,
    keys: str | Sequence[str],
    time: str,
    horizon: int = 1,
    span: str | None = None,
    p_value: bool = False,
) -> DataFrame:
    """Diebold and Mariano (1995) test that two forecasts have equal absolute error.

    Negative statistics favour ``first``. ``p_value`` adds ``adjusted``, the statistic times the
    small-sample factor of Harvey, Leybourne and Newbold (1997), and its two-sided ``p_value``
    under the normal distribution. The variance of the mean loss difference sums the
    autocovariances up to ``horizon - 1``, which need no second pass: with the mean known at
    the end, each follows from the sums of products and of the two shifted series.
    """
    keys = names(keys)
    loss = F.abs(F.col(y) - F.col(first)) - F.abs(F.col(y) - F.col(second))
    d = df.withColumn("_d", loss).where("_d is not null").select(*keys, time, "_d")
    shifts = {f"_d{k}": ("_d", k) for k in range(1, horizon)}
    if shifts:
        d = lags(d, shifts, keys, time, span)
    aggs = [F.count("_d").alias("rows"), F.avg("_d").alias("mean_loss_difference"),
            F.sum(F.col("_d") * F.col("_d")).alias("_s0")]
    for k in range(1, horizon):
        here = F.when(F.col(f"_d{k}").isNotNull(), F.col("_d"))
        aggs += [
            F.sum(F.col("_d") * F.col(f"_d{k}")).alias(f"_s{k}"),
            F.coalesce(F.sum(here), F.lit(0.0)).alias(f"_a{k}"),
            F.coalesce(F.sum(f"_d{k}"), F.lit(0.0)).alias(f"_b{k}"),
        ]
    out = d.groupBy(*keys).agg(*aggs)
    n, m = F.col("rows"), F.col("mean_loss_difference")
    variance = F.col("_s0") / n - m * m
    for k in range(1, horizon):
        products = F.coalesce(F.col(f"_s{k}"), F.lit(0.0))
        shared = F.greatest(n - k, F.lit(0))
        cov = (products - m * (F.col(f"_a{k}") + F.col(f"_b{k}")) + shared * m * m) / n
        variance = variance + 2.0 * cov
    statistic = F.when(variance > 0, m / F.sqrt(variance / n))
    out = out.select(*keys, "rows", "mean_loss_difference", statistic.alias("dm_statistic"))
    if not p_value:
        return out
    factor = F.greatest(n + 1 - 2 * horizon + horizon * (horizon - 1) / n, F.lit(0.0)) / n
    out = out.withColumn("adjusted", F.col("dm_statistic") * F.sqrt(factor))
    return out.withColumn("p_value", 2 * normal_tail(F.abs("adjusted")))


# Hart's rational approximation of the normal tail, highest power first.
TAIL_ABOVE = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_BELOW = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def normal_tail(z: str | Column) -> Column:
    """Probability that a standard normal value exceeds ``z`` (0 or more), to about 1e-14."""
    z = col(z)

    def polynomial(factors: Sequence[float]) -> Column:
        total = F.lit(factors[0])
        for f in factors[1:]:
            total = total * z + F.lit(f)
        return total

    density = F.exp(-z * z / 2)
    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + F.lit(float(k)) / far
    near = density * polynomial(TAIL_ABOVE) / polynomial(TAIL_BELOW)
    return F.when(z < 7.07106781186547, near).otherwise(density / far / 2.506628274631)


def probability_error(probability: str | Column, draws: Column) -> Column:
    """Standard error of a probability estimated from ``draws`` trials."""
    p = col(probability)
    return F.sqrt(p * (1.0 - p) / draws)


def is_low_probability(probability: str | Column) -> Column:
    return (col(probability) > 0.0) & (col(probability) < 0.02)
