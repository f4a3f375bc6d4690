"""What several operators need of Spark: input rows, partition counts, tables in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import materialise  # noqa: F401

#: Rows of one packed piece and partitions of one shuffle are sized by these, whatever the input's size.
PARTITION_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string); other columns, whatever their names, stay out of the work."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0


def partitions(spark: SparkSession, n_bytes: int, each: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for so many bytes: never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of finished rounds, each as large as a relation: it does so for jobs that
    nothing refers to any more, when it collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
