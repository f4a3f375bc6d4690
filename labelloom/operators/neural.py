"""Batch scoring with a plugged-in model, and a dense second classifier.

Python runs only as the forward pass per batch inside Spark tasks. Lengths, padding, arg-max
and metrics stay column expressions.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import settings
from labelloom.functions import arrays as ar
from labelloom.functions import text as tx
from labelloom.operators import audit, compare, metrics, tfidf
from labelloom.session import materialise

def length_stats(lengths: DataFrame, dataset: str, column: str) -> DataFrame:
    """The eleven-column summary of a length column."""
    counts = audit.counts_of(lengths, column, dataset)
    s = audit.length_summary(counts).join(audit.truncation_share(counts), "unit")
    return s.select(F.col("unit").alias("dataset"), "n_rows", "mean", F.col("p50").alias("median"),
                    "p90", "p95", "p99", "max", "pct_over_64", "pct_over_128", "pct_over_256")


# Batch scoring.

def centroid_head(df: DataFrame, features: str, label: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the nearest-centroid classifier: classes x width numbers from one aggregate."""
    means = df.groupBy(label).agg(*[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(width)])
    rows = means.orderBy(label).collect()  # one row per class
    weights = np.array([[r[f"m{i}"] for i in range(width)] for r in rows])
    return weights, -0.5 * (weights ** 2).sum(axis=1)


def linear_head(weights: np.ndarray, bias: np.ndarray) -> Callable:
    """A model factory for :func:`batch_logits`; any callable loading a model file fits as well."""
    def load() -> Callable:
        def forward(x: np.ndarray) -> np.ndarray:
            return x.astype("float64") @ weights.T + bias
        return forward
    return load


def save_head(spark: SparkSession, path: str, weights: np.ndarray, bias: np.ndarray) -> None:
    """Write a linear head as an .npz file to any file system that Spark reaches; an existing file stays and raises."""
    packed = io.BytesIO()
    np.savez(packed, weights=weights, bias=bias)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()


def read_head(path: str) -> Callable:
    """The forward pass of a file that :func:`save_head` wrote."""
    with np.load(path, allow_pickle=False) as held:
        return linear_head(held["weights"], held["bias"])()


def model_file(spark: SparkSession, path: str, read: Callable[[str], Callable] = read_head) -> Callable:
    """A model factory for :func:`batch_logits` from one file on storage, which must exist.

    Spark sends the file to each executor once and each Python worker calls ``read`` once, with
    the path of its copy; the weights travel neither in the plan nor in a closure. ``read`` returns
    the forward pass, so any file format fits. Files are told apart by their base names: two
    models of one application need different ones.
    """
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def load() -> Callable:
        return read(SparkFiles.get(name))
    return load


def batch_logits(df: DataFrame, load_model: Callable, features: str, width: int,
                 batch_size: int = settings.BATCH_SIZE, out: str = "logits") -> DataFrame:
    """Add model outputs. The model is loaded once per Python worker and called per batch."""
    score = predict_batch_udf(load_model, return_type=T.ArrayType(T.DoubleType()),
                              batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(out, score(F.col(features)))


def batch_score(df: DataFrame, load_model: Callable, features: str, width: int,
                batch_size: int = settings.BATCH_SIZE) -> DataFrame:
    """Add ``probabilities``, ``pred`` and ``confidence`` from one forward pass."""
    scored = batch_logits(df, load_model, features, width, batch_size)
    scored = scored.withColumn("probabilities", ar.softmax(F.col("logits")))
    return (scored.withColumn("pred", ar.argmax(F.col("probabilities")))
                  .withColumn("confidence", F.array_max("probabilities")).drop("logits"))


# Dense second classifier.

@dataclass
class DenseClassifier:
    vectors: Word2VecModel
    head: MultilayerPerceptronClassificationModel
    log: DataFrame
    best_epoch: int

    def save(self, path: str) -> None:
        self.vectors.write().overwrite().save(f"{path}/vectors")
        self.head.write().overwrite().save(f"{path}/head")
        self.log.withColumn("best_epoch", F.lit(self.best_epoch)).write.mode("overwrite").parquet(f"{path}/log")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DenseClassifier":
        log = spark.read.parquet(f"{path}/log")
        return cls(Word2VecModel.load(f"{path}/vectors"), MultilayerPerceptronClassificationModel.load(f"{path}/head"),
                   log.drop("best_epoch"), log.first().best_epoch)


def _with_dense(df: DataFrame, vectors: Word2VecModel) -> DataFrame:
    return vectors.transform(df.withColumn("_tokens", tx.tokens(F.col("text")))).drop("_tokens")


def _embedding_input(train: DataFrame, max_words: int) -> DataFrame:
    """(_tokens) of each row, restricted to the ``max_words`` most frequent words of all rows
    (ties to the lower word), which is what bounds the driver's word table."""
    rows = materialise(train.select(F.monotonically_increasing_id().alias("i"), tx.tokens(F.col("text")).alias("_tokens")))
    long = rows.select("i", F.posexplode("_tokens").alias("at", "term"))
    top = tfidf.most_frequent(materialise(long.groupBy("term").agg(F.count(F.lit(1)).alias("ctf"))), max_words)
    kept = long.join(top.select("term"), "term", "left_semi")
    back = kept.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t"))
    return back.select(F.col("t.term").alias("_tokens"))


def fit_dense(train: DataFrame, valid: DataFrame, width: int = 32, hidden: int = 16,
              checkpoints: list[int] | None = None, max_words: int = settings.MAX_FEATURES,
              partitions: int = 8, seed: int = settings.SEED, classes: int = settings.NUM_CLASSES) -> DenseClassifier:
    """Mean word vectors, then a small perceptron; training length chosen on ``valid``.

    The head is trained on from checkpoint to checkpoint (numbers of iterations in all) until
    the early-stopping rule ends it, and the one with the best macro-F1 is kept. ``partitions``
    is a parameter of the embedding like its width: the same data gives the same model on
    clusters of any size.
    """
    spark = train.sparkSession
    embed = Word2Vec(vectorSize=width, minCount=1, seed=seed, maxIter=1, numPartitions=partitions,
                     inputCol="_tokens", outputCol="features")
    vectors = embed.fit(_embedding_input(train, max_words))
    tr = _with_dense(train, vectors).select("label", "features").persist()
    va = _with_dense(valid, vectors).select("label", "features").persist()
    heads, log, before = {}, [], 0
    try:
        for epoch, steps in enumerate(checkpoints or [5, 10, 20, 40, 60], start=1):
            trainer = MultilayerPerceptronClassifier(
                layers=[width, hidden, classes], maxIter=steps - before, seed=seed,
                featuresCol="features", labelCol="label")
            if heads:
                trainer.setInitialWeights(heads[epoch - 1].weights)
            heads[epoch], before = trainer.fit(tr), steps
            scored = _with_prediction(va, heads[epoch])
            f1 = metrics.flat_metrics(metrics.confusion_record(scored, classes=classes)).first().macro_f1
            log.append((0, epoch, float(f1)))
            table = spark.createDataFrame(log, "run_id int, epoch int, macro_f1 double")
            row = compare.early_stop(table).first()
            if row.stop_epoch is not None:
                break
    finally:
        tr.unpersist()
        va.unpersist()
    return DenseClassifier(vectors, heads[row.best_epoch], table, row.best_epoch)


def _with_prediction(df: DataFrame, head: MultilayerPerceptronClassificationModel) -> DataFrame:
    scored = head.transform(df).withColumn("probabilities", vector_to_array("probability"))
    return (scored.withColumn("pred", ar.argmax(F.col("probabilities")))
                  .withColumn("confidence", F.array_max("probabilities"))
                  .drop("rawPrediction", "probability", "prediction"))


def predict_dense(df: DataFrame, model: DenseClassifier) -> DataFrame:
    return _with_prediction(_with_dense(df, model.vectors), model.head).drop("features")
