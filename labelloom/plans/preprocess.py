"""From raw rows to the split training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx
from labelloom.operators import cleaning, dedupe, split
from labelloom.session import materialise


def resolve(corpus: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Clean, drop empty texts, resolve duplicates on raw labels, then map the labels.

    The order matters: rows that differ only by a URL become duplicates after cleaning,
    and a conflict with an unmapped label is still a conflict. One shuffle in all.
    """
    cleaned = cleaning.drop_empty(cleaning.clean_rows(corpus), seen)
    return cleaning.normalize_labels(dedupe.resolve_duplicates(cleaned))


def prepare(corpus: DataFrame, share: float = settings.TEST_SHARE, seed: int = settings.SEED) -> DataFrame:
    """(row_id, text, label, split). The resolved rows are stored once because the exact
    split and everything after it read them several times; the split is a projection of them."""
    rows = materialise(resolve(corpus))
    return split.stratified_split(rows, share, seed).select("row_id", "text", "label", "split")


STAGES = ["raw", "not_blank", "labelled", "without_conflicts", "deduplicated", "mapped"]


def stage_counts(corpus: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    """(position, stage, n_rows, n_lost): rows left after each step of :func:`resolve`.

    Steps: blank texts go; texts without any label; texts with different labels; further rows
    of a text; texts whose label has no class. One aggregate over 32-byte digests.
    """
    known = list((mapping or settings.LABEL_MAP))
    cleaned = cleaning.clean_rows(corpus)
    groups = cleaned.groupBy(tx.text_key(F.col("text")).alias("k"), (F.trim("text") == "").alias("blank")).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    one = ~F.col("blank") & (F.col("low") == F.col("high"))
    left = [F.lit(True), ~F.col("blank"), ~F.col("blank") & F.col("low").isNotNull(), one]
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in left]
    sums += [F.count_if(one), F.count_if(one & F.col("low").isin(known))]
    row = groups.agg(*[c.cast("long").alias(s) for c, s in zip(sums, STAGES)])
    lines = [F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("n_rows"),
                      (F.col(STAGES[max(0, i - 1)]) - F.col(s)).alias("n_lost")) for i, s in enumerate(STAGES)]
    return row.select(F.inline(F.array(*lines)))
