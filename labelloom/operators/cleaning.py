"""Cleaning and label normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import text as tx


def clean_rows(df: DataFrame, mark_aware: bool = False) -> DataFrame:
    return df.withColumn("text", tx.clean(F.col("text"), mark_aware))


def drop_empty(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Remove rows whose text is blank. ``seen`` receives rows_in and rows_blank while the
    job that consumes the result runs, so counting costs no extra pass.

    The observation also keeps the optimiser from pushing the filter to the scan, where it
    would run the whole cleaning expression a second time, and ahead of any join.
    """
    blank = F.trim(F.col("text")) == ""
    counted = df.observe(seen or f"blank-rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows_in"),
                         F.count_if(blank).alias("rows_blank"))
    return counted.where(~blank)


def normalize_labels(df: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    """Map raw labels to class ids; rows with an unmapped or missing label are dropped."""
    pairs = (mapping or settings.LABEL_MAP).items()
    table = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    mapped = F.try_element_at(table, F.col("label")).cast("int")
    return df.withColumn("label", mapped).where(F.col("label").isNotNull())


def with_label_names(df: DataFrame, label: str = "label", out: str = "label_name") -> DataFrame:
    return df.withColumn(out, tx.class_name(F.col(label)))
