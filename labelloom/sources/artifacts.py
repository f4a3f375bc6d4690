"""Size of saved models and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file below ``path``; contents are pruned, only metadata is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("ignoreMissingFiles", True).load(path))
    return files.select("path", F.col("length").alias("bytes"))


def artifact_mb(spark: SparkSession, path: str) -> float:
    """Megabytes of a file or folder; 0.0 when nothing is there."""
    try:
        total = artifact_sizes(spark, path).agg(F.sum("bytes").alias("b")).first().b
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return 0.0
        raise
    return (total or 0) / 1024.0 ** 2
