"""Class-balanced multinomial logistic regression on Spark ML."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import arrays as ar
from labelloom.operators import batched, metrics
from labelloom.session import materialise


def class_weights(df: DataFrame) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")).cast("double")
    return counts.select("label", "n", F.round(weight, 6).alias("weight"))


TASK_BYTES = 32 * 1024 * 1024
# Executor storage that the fits of one search may take together.
CACHE_BYTES = 1024 * 1024 * 1024
# Relative change of the loss at which a fit of the search ends.
SEARCH_TOL = 1e-6


def training_table(df: DataFrame) -> DataFrame:
    """Store the feature rows and size their partitions by bytes.

    Every iteration sends all coefficients to each task and one gradient back, so many
    small partitions cost more than they gain. Merging neighbours needs no shuffle; a
    table large enough for its partition count stays as it is.
    """
    stored = materialise(df)
    stored_values = stored.agg(F.sum(F.size(F.unwrap_udt("features")["indices"]))).first()[0] or 0
    wanted = max(1, math.ceil(stored_values * 12 / TASK_BYTES))
    return stored.coalesce(wanted)


def class_sizes(df: DataFrame) -> dict[int, int]:
    return {r.label: r.n for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(df: DataFrame, c: float = 1.0, max_iter: int = settings.MAX_ITER, tol: float = 1e-6,
        sizes: dict[int, int] | None = None) -> LogisticRegressionModel:
    """Fit on (label, features); ``sizes`` are the class sizes when they are known already.

    The loss is averaged over the weights here, so the inverse regularisation strength
    ``c`` becomes 1 / (c * sum of weights); balanced weights add up to the row count.
    """
    counts = sizes or class_sizes(df)
    total = sum(counts.values())
    weights = {label: total / (len(counts) * n) for label, n in counts.items()}
    lookup = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    weighted = df.select("label", "features", F.try_element_at(lookup, F.col("label")).alias("weight"))
    trainer = LogisticRegression(
        family="multinomial", labelCol="label", featuresCol="features", weightCol="weight",
        standardization=False, regParam=1.0 / (c * total), elasticNetParam=0.0,
        maxIter=max_iter, tol=tol, aggregationDepth=2)
    return trainer.fit(weighted)


def predict(df: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Add ``probabilities``, the first most probable class ``pred`` and its ``confidence``."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c not in df.columns]
    return (scored.withColumn("pred", ar.argmax(F.col("probabilities")))
                  .withColumn("confidence", F.array_max("probabilities")).drop(*drop))


def coefficients(spark: SparkSession, model: LogisticRegressionModel) -> DataFrame:
    """(label, idx, coefficient), idx -1 being the intercept. Size: classes x vocabulary."""
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(k, -1, float(b)) for k, b in enumerate(intercepts)]
    rows += [(k, i, float(v)) for k, line in enumerate(matrix) for i, v in enumerate(line)]
    return spark.createDataFrame(rows, "label int, idx int, coefficient double")


class MacroF1(Evaluator):
    """Macro-averaged F1 of (label, pred), usable wherever Spark ML takes an evaluator."""

    def _evaluate(self, dataset: DataFrame) -> float:
        record = metrics.confusion_record(dataset)
        return metrics.flat_metrics(record).first().macro_f1

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class GridResult:
    table: DataFrame
    best_c: float
    model: LogisticRegressionModel


def fits_at_once(df: DataFrame, cache_bytes: int = CACHE_BYTES, most: int = 8) -> int:
    """How many copies of the feature rows fit into ``cache_bytes``: at least one, ``most`` at most."""
    values = df.agg(F.sum(F.size(F.unwrap_udt("features")["indices"]))).first()[0] or 0
    return int(max(1, min(most, cache_bytes // max(1, values * 12))))


def grid_search(df: DataFrame, grid: list[float] | None = None, evaluator: Evaluator | None = None,
                parallelism: int | None = None, max_iter: int = settings.MAX_ITER,
                tol: float = 1e-6, search_tol: float = SEARCH_TOL) -> GridResult:
    """Cross-validated choice of C on (label, fold, features), then a refit on all rows.

    Class weights and regularisation follow each training part. All fits of the search share one pass over the rows per
    iteration (``batched``); held-out rows are judged by macro-averaged F1. With an ``evaluator`` of the caller's the fits
    are separate Spark ML jobs, ``parallelism`` at a time, and it judges each one's predictions. The search stops a fit at
    ``search_tol``, the refit at ``tol``.
    """
    grid = grid or settings.C_GRID
    spark = df.sparkSession
    features = df.select("label", "fold", "features")
    if evaluator is None:
        scores = _search_batched(features, grid, max_iter, search_tol)
    else:
        scores = _search_separately(features, grid, evaluator, parallelism or fits_at_once(features), max_iter, search_tol)
    rows = spark.createDataFrame(scores, "c double, fold int, macro_f1 double")
    table = (rows.groupBy("c").agg(F.avg("macro_f1").alias("mean_macro_f1"),
                                   F.stddev_pop("macro_f1").alias("std_macro_f1"),
                                   F.count(F.lit(1)).alias("folds")))
    by_c = {c: [s for g, _, s in scores if g == c] for c in grid}
    best = max(grid, key=lambda c: sum(by_c[c]) / len(by_c[c]))  # first wins ties
    table = table.withColumn("is_best", F.col("c") == F.lit(best))
    return GridResult(table, best, fit(features, best, max_iter, tol))


def _search_batched(features: DataFrame, grid: list[float], max_iter: int, tol: float) -> list[tuple[float, int, float]]:
    """(c, fold, macro F1) of every cell of the search: one job per iteration for all fits, one pass to judge them."""
    packed = batched.pack(features)
    shape = features.agg(F.max("label").alias("label"), F.max(F.unwrap_udt("features")["size"]).alias("size")).first()
    folds = [r.fold for r in features.select("fold").distinct().orderBy("fold").collect()]
    fits = [batched.Fit(f, c) for c in grid for f in folds]
    found, _ = batched.solve(packed, fits, max(settings.NUM_CLASSES, shape.label + 1), shape["size"], max_iter, tol)
    judged = batched.held_out(packed, fits, found)
    flat = metrics.flat_metrics(metrics.confusion_record(judged, ["c", "fold"]), ["c", "fold"])
    return [(r.c, r.fold, r.macro_f1) for r in flat.select("c", "fold", "macro_f1").collect()]


def _search_separately(features: DataFrame, grid: list[float], judge: Evaluator, parallelism: int, max_iter: int,
                       tol: float) -> list[tuple[float, int, float]]:
    """The same cells by separate Spark ML fits over one stored feature table; each caches the blocks it trains on."""
    spark = features.sparkSession
    cells = features.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
    folds = sorted({r.fold for r in cells})

    def score(task: tuple[int, float]) -> tuple[float, int, float]:
        fold, c = task
        sizes: dict[int, int] = {}
        for r in cells:
            if r.fold != fold:
                sizes[r.label] = sizes.get(r.label, 0) + r.n
        model = fit(features.where(F.col("fold") != fold), c, max_iter, tol, sizes)
        return c, fold, judge.evaluate(predict(features.where(F.col("fold") == fold), model))

    # The weakest regularisation takes the most iterations, so it is started first.
    tasks = [(f, c) for c in sorted(grid, reverse=True) for f in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(score), tasks))


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)
