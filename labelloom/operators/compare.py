"""Predictions and results of several models side by side."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx
from labelloom.sources.results import PER_CLASS, SCORES, SUPPORTS

LOWER_IS_BETTER = ["inference_ms_per_sample", "peak_memory_mb"]


def join_predictions(truth: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Truth and two models' predictions by row id (unique on every side, so never skewed)."""
    return (truth.join(first.select("row_id", F.col("pred").alias("pred_a")), "row_id")
                 .join(second.select("row_id", F.col("pred").alias("pred_b")), "row_id"))


def model_agreement(joined: DataFrame) -> DataFrame:
    """How often each model is right, and how often they agree."""
    same = F.col("pred_a").eqNullSafe(F.col("pred_b"))
    a = F.col("pred_a").eqNullSafe(F.col("label"))
    b = F.col("pred_b").eqNullSafe(F.col("label"))
    counted = joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(a).alias("a_correct"),
        F.count_if(b).alias("b_correct"), F.count_if(same).alias("agree"),
        F.count_if(a & b).alias("both_correct"), F.count_if(~a & ~b).alias("both_wrong"))
    rate = F.coalesce(F.try_divide(F.col("agree").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
    return counted.withColumn("agreement", F.round(rate, 6))


def side_by_side(joined: DataFrame, width: int = 80) -> DataFrame:
    """Shortened text, class names and correctness flags per row."""
    return joined.select(
        "row_id", tx.shorten(F.col("text"), width).alias("text"),
        tx.class_name(F.col("label")).alias("true_label"),
        tx.class_name(F.col("pred_a")).alias("label_a"), tx.class_name(F.col("pred_b")).alias("label_b"),
        F.col("pred_a").eqNullSafe(F.col("label")).alias("a_correct"),
        F.col("pred_b").eqNullSafe(F.col("label")).alias("b_correct"))


def results_union(*results: DataFrame) -> DataFrame:
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def latest_per_model(results: DataFrame, key: str = "model", when: str = "run_ts",
                     tie: str | None = None) -> DataFrame:
    """The newest row of each model. An aggregate, so long histories fold on the map side."""
    rest = [c for c in results.columns if c != key]
    order = F.struct(when, tie) if tie else F.col(when)
    return (results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
                   .select(key, "_r.*"))


def metric_rows(flat: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """(model, position, metric, value): one row per model and metric."""
    return flat.select(key, F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for i, m in enumerate(metrics)])))


def _best(models: list[str], want_max: bool):
    """First model holding the best non-null value."""
    best = F.greatest(*[F.col(m) for m in models]) if want_max else F.least(*[F.col(m) for m in models])
    return F.coalesce(*[F.when(F.col(m) == best, F.lit(m)) for m in models])


def comparison_table(flat: DataFrame, models: list[str], costs: list[str] | None = None,
                     key: str = "model") -> DataFrame:
    """Metrics as rows, models as columns, and the winner by each metric's direction.

    Equal values go to the model listed first; support rows have no winner.
    """
    costs = costs or []
    rows = metric_rows(flat, SCORES + PER_CLASS + SUPPORTS + costs, key)
    wide = rows.groupBy("position", "metric").pivot(key, models).agg(F.first("value"))
    winner = (F.when(F.col("metric").isin(SCORES + PER_CLASS), _best(models, True))
               .when(F.col("metric").isin(LOWER_IS_BETTER), _best(models, False)).otherwise(""))
    return wide.withColumn("winner", winner)


def metric_winner(rows: DataFrame) -> DataFrame:
    """(metric, winner) from (metric, model, model_order, value) rows, any number of models."""
    up = F.max_by("model", F.struct("value", -F.col("model_order")))
    down = F.min_by("model", F.struct("value", "model_order"))
    metric = F.col("metric")
    return (rows.groupBy("metric").agg(up.alias("_up"), down.alias("_down"))
                .select("metric", F.when(metric.isin(LOWER_IS_BETTER), F.col("_down"))
                        .when(metric.startswith("support_"), "").otherwise(F.col("_up")).alias("winner")))


def run_cost(name: str, run: Callable[[], DataFrame]) -> dict:
    """Wall time and rows of one full evaluation of ``run()``, vectorisation included.

    The row count is observed by the same job that is timed.
    """
    seen = Observation()
    start = time.perf_counter()
    run().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - start
    rows = seen.get["rows"]
    return {"model": name, "rows": rows, "elapsed_s": elapsed,
            "ms_per_sample": elapsed * 1000 / rows if rows else 0.0}


def early_stop(log: DataFrame, run: str = "run_id", patience: int = settings.PATIENCE) -> DataFrame:
    """Per run: the epoch at which training stops and the best epoch up to then.

    ``log`` is (run, epoch, macro_f1). A window holds one run's epochs, which is a short list.
    """
    past = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    ordered = Window.partitionBy(run).orderBy("epoch")
    best_before = F.max("macro_f1").over(past)
    marked = log.withColumn("_better", F.when(
        best_before.isNull() | (F.col("macro_f1") > best_before), 1).otherwise(0))
    phased = marked.withColumn("_phase", F.sum("_better").over(ordered))
    stale = F.row_number().over(Window.partitionBy(run, "_phase").orderBy("epoch")) - 1
    counted = phased.withColumn("_stale", stale)
    stop = F.min(F.when(F.col("_stale") >= patience, F.col("epoch"))).over(Window.partitionBy(run))
    kept = counted.withColumn("stop_epoch", stop).where(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(
        F.max("stop_epoch").alias("stop_epoch"),
        F.max_by("epoch", F.struct("macro_f1", -F.col("epoch"))).alias("best_epoch"),
        F.round(F.max("macro_f1"), 6).alias("best_macro_f1"))


def training_curve(log: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, epoch, train_loss, eval_loss): mean logged loss of each epoch beside the n-th
    evaluation, trimmed to the shorter of the two.

    An entry logged at exactly epoch 1.0 counts for epoch 2.
    """
    train = (log.where(F.col("loss").isNotNull())
                .groupBy(run, (F.floor("epoch") + 1).alias("_e")).agg(F.avg("loss").alias("train_loss")))
    train = train.select(run, F.row_number().over(Window.partitionBy(run).orderBy("_e")).alias("epoch"),
                         F.round("train_loss", 6).alias("train_loss"))
    held = log.where(F.col("eval_loss").isNotNull()).select(
        run, F.row_number().over(Window.partitionBy(run).orderBy("step")).alias("epoch"),
        F.round("eval_loss", 6).alias("eval_loss"))
    return train.join(held, [run, "epoch"])
