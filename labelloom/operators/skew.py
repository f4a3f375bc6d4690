"""Joins of rows back to their group when single groups may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import settings


def rows_of_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str,
                   carry: list[str] | None = None,
                   hot_rows: int = settings.HOT_GROUP_ROWS) -> DataFrame:
    """Rows whose key occurs in ``groups`` (one row per key, ``size`` = rows of that key),
    with the ``carry`` columns of their group.

    ``groups`` is read twice and should be a stored table.

    A group above ``hot_rows`` is cut into about size / hot_rows salted parts, and its
    one group row is repeated once per part, so that no task holds a whole hot group.
    The list of hot keys is at most total rows / hot_rows eight-byte digests, which is
    what makes broadcasting it safe. Digests only choose the salt; the join itself
    compares the full key, so a digest collision cannot change the result.
    """
    digest = F.xxhash64(*[F.col(k) for k in keys])
    groups = groups.withColumn("_digest", digest)
    hot = (groups.where(F.col(size) > hot_rows).groupBy("_digest")
           .agg(F.max(F.ceil(F.col(size) / F.lit(hot_rows))).cast("int").alias("_parts")))

    def salted(df: DataFrame) -> DataFrame:
        return (df.join(F.broadcast(hot), "_digest", "left")
                  .withColumn("_parts", F.coalesce("_parts", F.lit(1))))

    left = salted(rows.withColumn("_digest", digest)).withColumn(
        "_salt", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int"))
    right = salted(groups).select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], *(carry or []),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_gsalt"))
    match = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys] + [F.col("_salt") == F.col("_gsalt")]
    return left.join(right, match).select(*rows.columns, *(carry or []))
