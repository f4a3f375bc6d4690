"""Exact stratified splits and folds.

Rows get a seeded pseudo-random key and each class is cut at exact ranks of that order.
Finding the cut keys needs no sort of the corpus: counts per (class, key bucket) locate
the bucket of each cut, only those buckets are ranked, and the final assignment is a
map-side comparison against a handful of cut keys. Keys derive from the seed and the text,
so the same corpus splits alike whatever files it comes in; row ids only break ties between
equal texts, of which a resolved corpus has none. Rows without a label are a class of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx
from labelloom.session import materialise

BUCKET_HEX_DIGITS = 4


def class_counts(df: DataFrame) -> DataFrame:
    """(label, n), one row per class."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def test_quotas(counts: DataFrame, share: float = settings.TEST_SHARE) -> DataFrame:
    """(label, n, k): ceil(share * total) test rows, apportioned by largest remainder; ties go
    to the lower label. The windows run over one row per class."""
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    exact = counts.withColumn("_want", F.ceil(total * F.lit(share)))
    exact = exact.withColumn("_ideal", F.col("n") * F.col("_want") / total.cast("double"))
    exact = exact.withColumn("_base", F.floor("_ideal")).withColumn(
        "_rest", F.col("_ideal") - F.col("_base"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.col("label"))
    extra = F.when(F.row_number().over(order)
                   <= F.col("_want") - F.sum("_base").over(everything), 1).otherwise(0)
    return exact.select("label", "n", (F.col("_base") + extra).cast("long").alias("k"))


def assign_pieces(rows: DataFrame, ends: DataFrame, seed: int = settings.SEED,
                  out: str = "piece") -> DataFrame:
    """Number each row's piece within its class.

    ``ends`` is (label, ends): ascending row counts at which the pieces end, the last piece
    excepted. ``rows`` is (row_id, text, label), read several times: a stored table.
    The plan of one row per class is stored, so the result is a projection of ``rows``.
    """
    key = tx.seeded_key(F.coalesce("text", F.lit("")), seed)
    keyed = rows.select("row_id", "label", key.alias("h"),
                        F.substring(key, 1, BUCKET_HEX_DIGITS).alias("bucket"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (keyed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    goals = ends.select(F.col("label").alias("_l"), F.explode_outer("ends").alias("goal"))
    holding = (buckets.join(F.broadcast(goals), F.col("label").eqNullSafe(F.col("_l")))
               .where((F.col("goal") > F.col("start")) & (F.col("goal") <= F.col("start") + F.col("n")))
               .groupBy("label", "bucket", "start").agg(F.collect_list("goal").alias("goals"))
               .withColumnRenamed("label", "_l").withColumnRenamed("bucket", "_b"))
    in_bucket = Window.partitionBy("label", "bucket").orderBy("h", "row_id")
    ranked = (keyed.join(F.broadcast(holding), F.col("label").eqNullSafe(F.col("_l")) & (F.col("bucket") == F.col("_b")))
              .withColumn("rank", F.col("start") + F.row_number().over(in_bucket)))
    cut = F.struct("h", "row_id")
    cuts = (ranked.withColumn("goal", F.explode("goals")).where(F.col("goal") == F.col("rank"))
            .groupBy("label").agg(F.collect_list(cut).alias("cuts")).withColumnRenamed("label", "_c"))
    # One row per class: its cut keys, and how many leading pieces are empty.
    plan = ends.join(cuts, F.col("label").eqNullSafe(F.col("_c")), "left").select(
        F.col("label").alias("_l"), F.coalesce("cuts", F.array().cast("array<struct<h:string,row_id:bigint>>")).alias("cuts"),
        F.size(F.filter("ends", lambda e: e <= 0)).alias("empty"))
    passed = F.size(F.filter("cuts", lambda c: c < F.struct(key.alias("h"), F.col("row_id"))))
    return (rows.join(F.broadcast(materialise(plan)), F.col("label").eqNullSafe(F.col("_l")))
                .withColumn(out, (passed + F.col("empty")).cast("int")).drop("cuts", "empty", "_l"))


def stratified_split(rows: DataFrame, share: float = settings.TEST_SHARE,
                     seed: int = settings.SEED) -> DataFrame:
    """Add ``split`` = 'test' or 'train' with exact per-class quotas."""
    ends = test_quotas(class_counts(rows), share).select("label", F.array("k").alias("ends"))
    return (assign_pieces(rows, ends, seed)
            .withColumn("split", F.when(F.col("piece") == 0, "test").otherwise("train"))
            .drop("piece"))


def stratified_folds(rows: DataFrame, folds: int = settings.FOLDS,
                     seed: int = settings.SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1, each class spread evenly over the folds."""
    ends = class_counts(rows).select("label", F.array(*[
        F.ceil(F.lit(i) * F.col("n") / F.lit(float(folds))).cast("long")
        for i in range(1, folds)]).alias("ends"))
    return assign_pieces(rows, ends, seed, out="fold")


def split_balance(split_rows: DataFrame) -> DataFrame:
    """(split, label, n, pct within the split)."""
    counts = split_rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return counts.select("split", "label", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))


def split_leakage(split_rows: DataFrame) -> DataFrame:
    """Distinct texts per side and on both sides; the last must be 0 after dedupe."""
    sides = (split_rows.groupBy(tx.text_key(F.col("text")).alias("key"))
             .agg(F.max(F.col("split") == "train").alias("tr"), F.max(F.col("split") == "test").alias("te")))
    return sides.agg(F.count_if("tr").alias("train_texts"), F.count_if("te").alias("test_texts"),
                     F.count_if(F.col("tr") & F.col("te")).alias("shared_texts"))
