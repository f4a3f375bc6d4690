"""The table behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelloom.operators import compare, metrics


def confusion_heat_map(predictions: DataFrame, normalize: bool = False) -> DataFrame:
    record = metrics.confusion_record(predictions)
    return metrics.confusion_matrix_norm(record) if normalize else metrics.confusion_matrix(record)


def loss_curve(log: DataFrame) -> DataFrame:
    return compare.training_curve(log)


def metric_bars(results: DataFrame) -> DataFrame:
    """(model, position, metric, value) of each model's newest run."""
    return compare.metric_rows(compare.latest_per_model(results),
                               ["accuracy", "macro_f1", "weighted_f1"])


def prediction_table(joined: DataFrame, rows: int = 12) -> DataFrame:
    return compare.side_by_side(joined).orderBy("row_id").limit(rows)
