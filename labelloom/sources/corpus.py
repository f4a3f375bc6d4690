"""Reading raw corpora and reading/writing the processed split table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as tx
from labelloom.sources import snapshots

RAW_SCHEMA = T.StructType([
    T.StructField("Unnamed: 0", T.LongType()),
    T.StructField("Sentences", T.StringType()),
    T.StructField("Sentiment", T.DoubleType()),
])
SPLIT_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("split", T.StringType()),
])


def canonical(raw: DataFrame, text: str = "Sentences", label: str = "Sentiment",
              index: str = "Unnamed: 0") -> DataFrame:
    """Rename to (row_id, text, label). The exported index, when present, is the row order;
    otherwise an increasing id in scan order takes its place."""
    row_id = F.col(f"`{index}`") if index in raw.columns else F.monotonically_increasing_id()
    return raw.select(
        row_id.cast("long").alias("row_id"),
        F.col(text).cast("string").alias("text"),
        F.col(label).cast("int").alias("label"),
    )


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with quoted newlines; NA spellings become NULL. A missing path raises.

    The header decides which columns are there, so only the header line is looked at
    before the scan; types come from the fixed schema. A text with line breaks forbids
    splitting one file, so a large corpus should arrive as many files.
    """
    header = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    names = ["Unnamed: 0" if c in ("", "_c0") else c for c in header]
    known = {f.name: f.dataType for f in RAW_SCHEMA}
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (spark.read.schema(schema).option("header", True).option("multiLine", True)
           .option("enforceSchema", False)  # a file with another header raises
           .option("escape", '"').option("mode", "FAILFAST").csv(path))
    typed = raw.select(*[
        (tx.null_tokens_to_null(F.col(f"`{n}`"))
         if n not in known or isinstance(known[n], T.StringType)
         else tx.null_tokens_to_null(F.trim(F.col(f"`{n}`"))).cast(known[n])).alias(n)
        for n in names])
    return canonical(typed)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Redistribute a bare table scan by its unique key where the session's ``spark.labelloom.spread``
    names a number of partitions: tests and benches read single files with one row group.
    """
    parts = scan.sparkSession.conf.get("spark.labelloom.spread", None)
    return scan.repartition(int(parts), key) if parts else scan


def write_splits(df: DataFrame, path: str) -> None:
    """Replace the table in one step; one folder per split so that readers prune partitions."""
    rows = df.select("row_id", "text", "label", "split")
    snapshots.replace(df.sparkSession, path, lambda to: rows.write.partitionBy("split").parquet(to))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of the table as published last; raises when the split was never written."""
    # without a version the missing folder of published names is what raises
    stored = snapshots.current(spark, path) or f"{path}/{snapshots.PUBLISHED}"
    table = spark.read.schema(SPLIT_SCHEMA).parquet(stored).where(F.col("split") == split)
    if table.isEmpty():
        raise FileNotFoundError(f"no '{split}' rows under {path}")
    return table.drop("split")
