"""Boosted-tree regression on feature frames, with MLlib."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom._common import names
from seriesloom.config import STORM_KP, TreeSettings
from seriesloom.functions.clean import clip
from seriesloom.operators.clean import require_columns
from seriesloom.operators.splits import fold_parts, numbered
from seriesloom.operators.verify import contingency, r2, regression_scores
from seriesloom.operators.windows import last_row, number_rows
from seriesloom.session import together, use_checkpoints, written
from seriesloom.sources.publish import current, publish

PREDICTION = "prediction"
ABOVE = "_above_mean"
TASK_ROWS = 20_000


def regressor(features: Sequence[str], label: str, settings: TreeSettings) -> Pipeline:
    """Unfitted: assemble the features in their fixed order, standardise, boosted trees.

    Its ``label`` is the target less its mean, which ``fit`` adds back. Trees take part by their
    leaves (``min_leaf``); MLlib has no least number of rows to split a node.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            GBTRegressor(
                featuresCol="_scaled",
                labelCol=label,
                predictionCol=ABOVE,
                maxIter=settings.trees,
                maxDepth=settings.depth,
                stepSize=settings.rate,
                subsamplingRate=settings.row_share,
                minInstancesPerNode=settings.min_leaf,
                seed=settings.seed,
            ),
        ]
    )


def fit(df: DataFrame, features: Sequence[str], label: str, settings: TreeSettings) -> PipelineModel:
    """Fit on all rows, one model for all series. Runs jobs.

    Boosting starts from the label's mean: the trees learn what is above it, and the last stage
    of the model, saved with it, adds it back. Without trees the prediction is the mean. Each
    tree is some short jobs, so a small frame is put into few tasks of ``TASK_ROWS`` rows.
    """
    require_columns(df, [*features, label])
    facts = df.agg(F.count(label).alias("n"), F.avg(label).alias("mean")).first()
    if not facts.n:
        raise ValueError("no rows to train on")
    use_checkpoints(df.sparkSession)
    mean = f"CAST('{facts.mean!r}' AS DOUBLE)"
    if not settings.trees:
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {mean} AS {PREDICTION} FROM __THIS__")])
    rows = df.select(*features, (F.col(label) - facts.mean).alias("_label"))
    fitted = regressor(features, "_label", settings).fit(rows.coalesce(max(1, -(-facts.n // TASK_ROWS))))
    whole = SQLTransformer(statement=f"SELECT *, {ABOVE} + {mean} AS {PREDICTION} FROM __THIS__")
    return PipelineModel([*fitted.stages, whole])


def trees_of(model: PipelineModel) -> GBTRegressionModel:
    """The boosted trees of a fitted model."""
    return next(s for s in model.stages if isinstance(s, GBTRegressionModel))


def predict(
    model: PipelineModel,
    df: DataFrame,
    name: str = PREDICTION,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    scored = model.transform(df).drop("_raw", "_scaled", ABOVE)
    out = scored.withColumn(PREDICTION, clip(PREDICTION, low, high))
    return out if name == PREDICTION else out.withColumnRenamed(PREDICTION, name)


def score_latest(
    model: PipelineModel,
    frame: DataFrame,
    keys: str | Sequence[str],
    time: str,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Prediction for the newest row of every series."""
    return predict(model, last_row(frame, keys, time), low=low, high=high)


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    settings: TreeSettings,
    keys: str | Sequence[str],
    time: str,
    folds: int = 5,
    gap: int = 3,
    max_rows: int | None = None,
    threshold: float = STORM_KP,
    at_once: int | None = None,
) -> DataFrame:
    """Scores per fold: ``fold, rows, mae, r2, csi``. Runs one fit per fold.

    The rows are numbered and written once; a fold is a filter on their positions. Fits are
    many short jobs, so ``at_once`` of them, all unless given, run side by side; the scores
    do not depend on it.
    """
    rows = written(numbered(df.select(*names(keys), time, *features, label), keys, time, max_rows), "folds")

    def score(k: int) -> DataFrame | None:
        in_train, in_test = fold_parts(F.lit(k), folds, gap)
        train = rows.where(in_train)
        if train.isEmpty():
            return None
        model = fit(train, features, label, settings)
        return predict(model, rows.where(in_test)).select(F.lit(k).alias("fold"), label, PREDICTION)

    made = together(df.sparkSession, [partial(score, k) for k in range(folds)], "fold", at_once)
    scored = [part for part in made if part is not None]
    if not scored:
        raise ValueError("no series is long enough for cross-validation")
    pairs = reduce(DataFrame.unionByName, scored)
    errors = regression_scores(pairs, label, PREDICTION, "fold")
    events = contingency(pairs, label, PREDICTION, threshold, "fold").select("fold", "csi")
    return errors.join(events, "fold")


def fold_summary(scores: DataFrame, columns: Sequence[str] = ("mae", "r2", "csi")) -> DataFrame:
    """Mean, population deviation and half-width of the 95 % interval over folds."""
    aggs = [F.count(F.lit(1)).alias("folds")]
    for c in columns:
        deviation = F.stddev_pop(c)
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            deviation.alias(f"{c}_std"),
            (F.lit(1.96) * deviation / F.sqrt(F.count(c))).alias(f"{c}_ci95"),
        ]
    return scores.agg(*aggs)


def impurity_importance(
    spark, model: PipelineModel, features: Sequence[str]
) -> DataFrame:
    """Share of the impurity reduction per feature; as many rows as the model has inputs."""
    values = trees_of(model).featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(
    model: PipelineModel,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    order: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
    slice_rows: int = 10_000,
    min_rows: int = 20,
) -> DataFrame:
    """Loss of R² when one feature is shuffled over the test rows, mean over the repeats.

    ``order`` names columns that identify a row. Each repeat numbers the rows twice by two
    hashes of them, slice by slice, and pairs equal numbers: a random permutation without a
    global sort. One permutation serves all features of a repeat. A slice holds about
    ``slice_rows`` rows. With fewer than ``min_rows`` rows every feature has a NULL importance
    and the status ``too few rows``. Runs a count.
    """
    base = test.select(*order, *features, label)
    count = base.count()
    if count < min_rows:
        none = [(f, None, None, "too few rows") for f in features]
        return test.sparkSession.createDataFrame(
            none, "feature string, importance double, importance_std double, status string"
        )
    slices = max(1, -(-count // slice_rows))
    spread = base.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def numbered(df: DataFrame, salt: int) -> DataFrame:
        hashed = df.withColumn("_h", F.xxhash64(*order, "_repeat", F.lit(seed * 2 + salt)))
        return number_rows(
            hashed, ["_repeat"], ["_h", *order], F.floor(F.shiftrightunsigned("_h", 32) * slices / 2**32), "_pos"
        ).drop("_h")

    own = numbered(spread, 0).select("_repeat", "_pos", label, *features)
    other = numbered(spread, 1).select(
        "_repeat", "_pos", *[F.col(f).alias(f"_other_{f}") for f in features]
    )
    paired = own.join(other, ["_repeat", "_pos"])
    variants = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[F.col(f"_other_{g}" if g == f else g).alias(g) for g in features],
            )
            for f in features
        ]
    )
    shuffled = paired.select("_repeat", label, F.explode(variants).alias("_v")).select(
        "_repeat", label, "_v.*"
    )
    lost = predict(model, shuffled).groupBy("feature", "_repeat").agg(r2(label, PREDICTION).alias("_r2"))
    whole = predict(model, base).agg(r2(label, PREDICTION)).scalar()
    drop = whole - F.col("_r2")
    return lost.select("feature", drop.alias("_drop")).groupBy("feature").agg(
        F.avg("_drop").alias("importance"),
        F.stddev_pop("_drop").alias("importance_std"),
        F.lit("ok").alias("status"),
    )


def settings_key(**settings) -> str:
    """Short stable name of a training setup."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def fit_or_load(
    spark, store: str, key: str, train: Callable[[], PipelineModel]
) -> tuple[PipelineModel, bool]:
    """The stored model of a training setup, or a new one that is then stored.

    Returns the model and whether it was reused. Every save is a version of its own that is
    published when complete, so two trainers of one setup do not touch each other's files and
    a reader gets a whole model; the later one is the current one from then on.
    """
    base = f"{store.rstrip('/')}/{key}"
    stored = current(spark, base)
    if stored is not None:
        return PipelineModel.load(stored), True
    model = train()
    publish(spark, base, model.save)
    return model, False
