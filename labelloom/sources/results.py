"""Result rows, comparison summaries and length statistics on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import settings
from labelloom.sources import snapshots

SCORES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]
COSTS = ["training_time_s", "inference_time_s", "inference_ms_per_sample",
         "peak_memory_mb", "model_size_mb"]
PER_CLASS = [f"{m}_{c}" for m in ("precision", "recall", "f1") for c in settings.LABEL_NAMES]
SUPPORTS = [f"support_{c}" for c in settings.LABEL_NAMES]

RESULT_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("run_ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in SCORES + PER_CLASS]
    + [T.StructField(c, T.LongType()) for c in SUPPORTS]
    + [T.StructField(c, T.DoubleType()) for c in COSTS])


def as_result_rows(df: DataFrame) -> DataFrame:
    """Project onto the fixed result schema; columns a run does not have become NULL."""
    extra = set(df.columns) - set(RESULT_SCHEMA.names)
    if extra:
        raise ValueError(f"columns outside the result schema: {sorted(extra)}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns
         else F.current_timestamp() if f.name == "run_ts" else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA])


def append_results(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Keep every run; readers choose with ``compare.latest_per_model``.

    A run has a folder of its own. With a ``run_id`` a repeated append of a run that is complete
    adds nothing, and one that was broken off starts anew.
    """
    folder = f"{path}/run={run_id or uuid.uuid4().hex}"
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        as_result_rows(df).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(folder)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def write_comparison(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_length_stats(stats: DataFrame, lengths: DataFrame, path: str) -> None:
    """Replace both tables in one step."""
    def write(to: str) -> None:
        stats.write.parquet(f"{to}/summary")
        lengths.write.parquet(f"{to}/lengths")

    snapshots.replace(stats.sparkSession, path, write)


def read_length_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved summary, or None when none was written (not an error)."""
    stored = snapshots.current(spark, path)
    return None if stored is None else spark.read.parquet(f"{stored}/summary")
