"""Train on the training split, predict the test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx
from labelloom.operators import cleaning, compare, dedupe, linear, metrics, split, tfidf
from labelloom.sources import results


@dataclass
class TextScorer:
    """Cleaning, features and classifier as one function of a DataFrame (batch or stream).

    Scoring is a projection, without shuffle or state, up to MAX_BROADCAST_BYTES of vocabulary;
    a larger one is joined.
    """

    features: tfidf.Tfidf
    model: LogisticRegressionModel

    def save(self, path: str) -> None:
        self.features.save(f"{path}/features")
        linear.save(self.model, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextScorer":
        return cls(tfidf.Tfidf.load(spark, f"{path}/features"), linear.load(f"{path}/model"))

    def predict(self, df: DataFrame) -> DataFrame:
        """For text that is clean already."""
        return linear.predict(tfidf.with_vectors(df, self.features), self.model).drop("features")

    def score(self, df: DataFrame) -> DataFrame:
        """For new text: label name, confidence and one probability column per class."""
        scored = self.predict(cleaning.clean_rows(df))
        named = cleaning.with_label_names(scored, "pred", "pred_name")
        return named.select("*", *[
            F.col("probabilities")[i].alias(f"prob_{name}")
            for i, name in enumerate(settings.LABEL_NAMES)]).drop("probabilities")


def halves(split_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = split_rows.where(F.col("split") == "train").drop("split")
    test = split_rows.where(F.col("split") == "test").drop("split")
    return train, test


def fit_scorer(train: DataFrame, c: float = settings.FIXED_C, max_features: int = settings.MAX_FEATURES,
               how: tfidf.Vectorizer = tfidf.Vectorizer()) -> TextScorer:
    features = tfidf.fit(train, max_features, how=how)
    vectors = linear.training_table(tfidf.with_vectors(train.select("label", "text"), features)
                                    .select("label", "features"))
    return TextScorer(features, linear.fit(vectors, c))


def tune_scorer(train: DataFrame, grid: list[float] | None = None, folds: int = settings.FOLDS,
                max_features: int = settings.MAX_FEATURES) -> tuple[TextScorer, linear.GridResult]:
    """Choose C by cross-validation; the features are fitted once on all training rows."""
    features = tfidf.fit(train, max_features)
    folded = split.stratified_folds(train, folds)
    vectors = linear.training_table(
        tfidf.with_vectors(folded, features).select("label", "fold", "features"))
    result = linear.grid_search(vectors, grid)
    return TextScorer(features, result.model), result


def result_row(name: str, predictions: DataFrame, training_s: float, cost: dict, model_mb: float) -> DataFrame:
    """One row of the results table: metrics of (label, pred) plus the run's costs, where
    ``cost`` comes from ``compare.run_cost``."""
    flat = metrics.flat_metrics(metrics.confusion_record(predictions))
    return results.as_result_rows(flat.select(
        F.lit(name).alias("model"), "*", F.lit(training_s).alias("training_time_s"),
        F.lit(cost["elapsed_s"]).alias("inference_time_s"),
        F.lit(cost["ms_per_sample"]).alias("inference_ms_per_sample"), F.lit(model_mb).alias("model_size_mb")))


def sample_predictions(rows: DataFrame, k: int = 3, width: int = settings.PREVIEW_CHARS) -> DataFrame:
    """First ``k`` rows of each true class of (row_id, text, label, pred, confidence), texts shortened."""
    picked = dedupe.samples_per_class(rows.select("row_id", "text", "label", "pred", "confidence"), k)
    return picked.select("row_id", "position", tx.shorten(F.col("text"), width).alias("text"),
                         tx.class_name(F.col("label")).alias("true_label"), tx.class_name(F.col("pred")).alias("predicted"),
                         F.col("pred").eqNullSafe(F.col("label")).alias("correct"), F.round("confidence", 4).alias("confidence"))


def compare_fitted(models: dict[str, DataFrame], costs: dict[str, dict]) -> DataFrame:
    """Metrics and costs of several models' predictions on one test part, and each metric's winner.

    ``models`` maps a name to (label, pred) rows, ``costs`` to what ``compare.run_cost`` measured.
    """
    flat = None
    for name, scored in models.items():
        row = metrics.flat_metrics(metrics.confusion_record(scored)).select(
            F.lit(name).alias("model"), "*", F.lit(costs[name]["ms_per_sample"]).alias("inference_ms_per_sample"))
        flat = row if flat is None else flat.unionByName(row)
    return compare.comparison_table(flat, list(models), ["inference_ms_per_sample"])


def test_metrics(split_rows: DataFrame, c: float = settings.FIXED_C) -> DataFrame:
    """Per-class metrics on the test split of a scorer fitted on the training split."""
    train, test = halves(split_rows)
    scored = fit_scorer(train, c).predict(test)
    return metrics.metrics_per_class(metrics.confusion_record(scored))
