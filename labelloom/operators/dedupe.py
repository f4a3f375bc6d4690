"""Duplicate and conflict handling over (row_id, text, label).

``row_id`` is unique and stands for row order. Grouping by text is always an aggregate
with fixed-size buffers, so a text that makes up a third of the corpus is folded on the
map side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx
from labelloom.operators import skew
from labelloom.session import materialise


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One row per (text, label), the first occurrence."""
    return df.groupBy("text", "label").agg(F.min("row_id").alias("row_id"))


def conflict_texts(df: DataFrame) -> DataFrame:
    """Texts carrying more than one distinct non-null label, with their row count."""
    return (df.groupBy("text")
              .agg(F.min("label").alias("min_label"), F.max("label").alias("max_label"),
                   F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("min_label") != F.col("max_label")))


def conflict_rows(df: DataFrame, hot_rows: int = settings.HOT_GROUP_ROWS) -> DataFrame:
    """Every row of a conflicting text, ordered by text then label.

    The conflicting texts are stored first: the salted join reads them twice, and the
    optimiser would otherwise aggregate the corpus once per read.
    """
    rows = skew.rows_of_groups(df, materialise(conflict_texts(df)), ["text"], "n_rows", hot_rows=hot_rows)
    return rows.orderBy("text", "label", "row_id")


def drop_conflicts(df: DataFrame) -> DataFrame:
    """Rows of texts without conflict, as an anti join (the two-step form of
    :func:`resolve_duplicates`, after ``dedupe_exact`` has left few rows per text)."""
    return df.join(conflict_texts(df).select("text"), "text", "left_anti")


def resolve_duplicates(df: DataFrame) -> DataFrame:
    """First row of every text that has exactly one distinct non-null label.

    Exact dedupe, conflict detection and the anti join fuse into one aggregate and
    therefore one shuffle of the texts. Texts without any label drop out here; the
    label mapping would drop them anyway.
    """
    labelled = F.when(F.col("label").isNotNull(), F.col("row_id"))
    return (df.groupBy("text")
              .agg(F.min("label").alias("label"), F.max("label").alias("_max"),
                   F.min(labelled).alias("row_id"))
              .where(F.col("label") == F.col("_max"))
              .select("row_id", "text", "label"))


def repeat_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier (text, label) pair.

    Digests are aggregated, not texts; only pairs that occur twice go on, and their rows are
    found by a join that splits large groups.
    """
    return _in_groups(df).where(F.col("row_id") != F.col("first")).select(*df.columns)


def dup_group_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Every row of a (text, label) pair that occurs more than once, ordered by text.

    See :func:`repeat_rows` for how the rows are found.
    """
    out = _in_groups(df).select("row_id", "text", "label").orderBy("text", "label", "row_id")
    return out if limit is None else out.limit(limit)


def _in_groups(df: DataFrame) -> DataFrame:
    """Rows of the (text, label) pairs that occur more than once, with the pair's ``first`` row id.

    A 32-byte digest of the text stands for it: no two texts are known to share one.
    """
    keyed = df.withColumn("_key", tx.text_key(F.coalesce("text", F.lit("")))).withColumn("_null", F.col("text").isNull())
    groups = (keyed.groupBy("_key", "_null", "label").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1))
    return skew.rows_of_groups(keyed, materialise(groups), ["_key", "_null", "label"], "n", carry=["first"])


def samples_per_class(df: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` rows of each label. Ids and labels alone are ranked, each task keeping its
    own first ``k`` per label; the rows are fetched by id."""
    order = Window.partitionBy("label").orderBy("row_id")
    ranked = (df.select("row_id", "label").where(F.col("label").isNotNull())
                .withColumn("position", F.row_number().over(order)).where(F.col("position") <= k))
    return df.join(ranked.select("row_id", "position"), "row_id").select(*df.columns, "position")
