"""Connected components of a link table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a bigint, b bigint) links -> (node, root): every linked node and the smallest node of its component.

    Each round writes its links to the shared folder, so an executor's loss costs one round at most. A star's centre
    may have any number of neighbours: it is one row on the joined side and its neighbours can be split freely.
    The driver sees one count and one checksum per round. Null ends and self links are ignored.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if mark.n == 0 or (mark.n, mark.x) == seen:
            break
        seen = (mark.n, mark.x)
        # large star: neighbours above u move to the smallest of u and its neighbours
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("w")).union(edges.select("v", "u"))
        low = both.groupBy("c").agg(F.least(F.min("w"), F.col("c")).alias("m"))
        large = both.where("w > c").join(low, "c").select(F.col("w").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: neighbours below v, and v, move to the smallest neighbour
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        edges = materialise(small.select("e.*").where("v <> u").distinct())
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    roots = edges.groupBy("v").agg(F.min("u").alias("u"))
    return roots.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        roots.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
