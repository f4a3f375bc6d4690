"""A Merkle manifest of a document table: leaves per row, trees of fanout 16 per source, one root over the sources.

A level is one aggregate: conditional aggregates spread the up to 16 children of a parent into slot columns (a slot
pivot). All columns concatenated and hashed are the parent; all but the own column are a child's siblings. Levels are
stored tables, each a sixteenth of the one below, so a proof is made by handing every parent's path down to its children.

Places in a source come from one range exchange of the leaves (about 150 bytes a row, no texts): a row's place is its
position in its partition plus what the partitions before hold of its source, so a source of any share of the rows is
numbered by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import shared

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of one leaf row on its way to its place.
LEAF_BYTES = 160
#: Tables of one row per source and partition are broadcast up to so many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20

SLOTS = [f"s{j}" for j in range(FANOUT)]


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(fields[c]) for c in FIELDS]), 256)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned CRC-32 of the decimal id; a null id never is."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, other, row) of every row: ``other`` is the leaf after tampering, null where that changes nothing."""
    kinds = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
    rows = docs.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in FIELDS])
    lowered = F.translate("text", UPPER, LOWER)
    own = {c: F.col(c) for c in FIELDS}
    other = F.when(tampered(F.col("doc_id")) & F.col("text").rlike("[A-Z]"), leaf_hash(own | {"text": lowered}))
    return shared.materialise(rows.select("doc_id", "source", leaf_hash(own).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row")))


def small(df: DataFrame, key: str) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its measured size allows it."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(key), F.lit(0)) + 48).alias("b")).first().b or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def placed(leaf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, idx, n; sources as (tree, source)): trees are numbered in the order of the sources, null first.

    ``idx`` is the row's place in its source by (doc_id, leaf), null ids first, and ``n`` the source's number of rows.
    """
    parts = shared.partitions(leaf.sparkSession, leaf.count() * LEAF_BYTES)
    order = ["source", "doc_id", "leaf", "row"]
    # the id after the exchange and sort is the partition's number and the position in it
    rows = shared.materialise(leaf.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    held = shared.materialise(rows.groupBy(part.alias("part"), "source").agg(F.min("at").alias("first"), F.count("*").alias("held")))
    sources = held.groupBy("source").agg(F.min("part").alias("begins"), F.sum("held").alias("n"))
    # one row per partition
    starts = sources.groupBy("begins").agg(F.count("*").alias("k")).select("begins", (F.sum("k").over(Window.orderBy("begins")) - F.col("k")).alias("before"))
    tree = F.col("before") + F.row_number().over(Window.partitionBy("begins").orderBy("source")) - 1
    sources = shared.materialise(sources.join(starts, "begins").select(tree.alias("tree"), "source", "n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "source", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    base = shared.materialise(base.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("part").alias("p"), F.col("b.source").alias("of"), "shift", "tree", "n"))
    joined = rows.join(small(base, "of"), (part == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.select("tree", (F.col("at") + F.col("shift")).alias("idx"), "n", "doc_id", "leaf", "other"), sources.select("tree", "source")


@dataclass
class Forest:
    """Trees over one numbering: ``levels[k]`` holds the parents made from the nodes of level k, ``tops`` the roots."""

    levels: list[DataFrame]
    tops: DataFrame


def climb(nodes: DataFrame, carry: list[str]) -> Forest:
    """Trees over nodes (tree, idx, n, hash, *carry); n is the number of nodes of the tree.

    Level rows are (tree, idx, n, hash, slots): n counts the level's own nodes; the slot columns are stored as an array of 16,
    null where there is no child. The lowest level's slots are structs (hash, *carry), the others' hashes alone. ``tops`` are (tree, hash), one per tree, also of trees with a single node.
    """
    levels, tops, slot, first = [], [], (F.col("idx") % FANOUT), True
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops.append(nodes.where("n = 1").select("tree", "hash"))
    while most > 1:
        child = F.struct("hash", *carry) if first else F.col("hash")
        spread = [F.max(F.when(slot == j, child)).alias(s) for j, s in enumerate(SLOTS)]
        wide = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.ceil(F.max("n") / F.lit(FANOUT)).alias("n"), *spread)
        hashes = [F.col(f"{s}.hash") if first else F.col(s) for s in SLOTS]
        nodes = shared.materialise(wide.select("tree", "idx", "n", F.sha2(F.concat_ws("", *hashes), 256).alias("hash"), F.array(*SLOTS).alias("slots")))
        levels.append(nodes)
        tops.append(nodes.where("n = 1").select("tree", "hash"))
        most, first = -(-most // FANOUT), False
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return Forest(levels, out)


def children(level: DataFrame, lowest: bool, carry: list[str]) -> DataFrame:
    """(tree, idx, path, hash, *carry) of the children of parents with a path: own siblings first, the parent's path after them.

    A path is an array of (left, right): what to put before and after the own hash, level by level up to the root.
    """
    hashes = F.col("slots.hash") if lowest else F.col("slots")

    def child(slot: Column, j: Column) -> Column:
        pair = F.struct(F.array_join(F.slice(hashes, F.lit(1), j), "").alias("left"), F.array_join(F.slice(hashes, j + 2, F.lit(FANOUT)), "").alias("right"))
        return F.when(slot.isNotNull(), F.struct(j.alias("slot"), pair.alias("pair"), (slot if lowest else F.struct(slot.alias("hash"))).alias("own")))
    made = level.select("tree", "idx", "path", F.explode(F.array_compact(F.transform("slots", child))).alias("c"))
    return made.select("tree", (F.col("idx") * FANOUT + F.col("c.slot")).alias("idx"), F.concat(F.array("c.pair"), "path").alias("path"), "c.own.hash", *([f"c.own.{c}" for c in carry] if lowest else []))


def descend(forest: Forest, above: DataFrame, carry: list[str]) -> DataFrame | None:
    """(tree, idx, path, hash, *carry) of every lowest node of a tree of several; ``above`` is (tree, path of the tree's root)."""
    paths, above = None, above.withColumnsRenamed({"tree": "t", "path": "over"})
    for k in range(len(forest.levels) - 1, -1, -1):
        level = forest.levels[k]
        known = level.where("n = 1").join(above, F.col("tree") == F.col("t")).select(*level.columns, F.col("over").alias("path"))
        if paths is not None:
            given = paths.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "path")
            known = known.unionByName(level.where("n > 1").join(given, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i"))).select(*level.columns, "path"))
        paths = children(known, k == 0, carry)
        if k:
            paths = shared.materialise(paths)
    return paths


NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, other, folded_root, verified) for every row of the document columns.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each with its length, ``-`` if null. Leaves of a
    source ascend by doc_id (null first, rows alike in it by leaf) and are hashed in runs of 16 up to the subroot; the
    subroots, by source (null first, then bytewise), likewise up to the root. ``proof`` holds the siblings as (left,
    right) per level. ``other`` is the leaf of the row with its A-Z lower-cased, where the row is one to tamper with and
    that changes it; ``folded_root`` is folded from it, else from the leaf. Repeated rows are leaves of their own, a
    single row is the root itself and has an empty proof, an empty table gives no row. Other columns are ignored.
    """
    rows, sources = placed(leaves(docs))
    rows = shared.materialise(rows.withColumnRenamed("leaf", "hash"))
    forest = climb(rows, ["doc_id", "other"])
    subroots = shared.materialise(forest.tops.withColumnRenamed("hash", "subroot"))
    over = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).cast("bigint").alias("n"), F.col("subroot").alias("hash"))
    roof = climb(over, [])
    paths = descend(roof, sources.sparkSession.range(1).select(F.lit(0).alias("tree"), F.expr(NO_PATH).alias("path")), [])
    # a table of one source has no level above its subroot
    above = subroots.select("tree", F.expr(NO_PATH).alias("path")) if paths is None else paths.select(F.col("idx").alias("tree"), "path")
    above = shared.materialise(above)
    below = descend(forest, above, ["doc_id", "other"])
    lone = rows.where("n = 1").join(above, "tree").select("tree", "path", "hash", "doc_id", "other")
    every = lone if below is None else below.select(*lone.columns).unionByName(lone)
    root = roof.tops.first()  # one hash, none if the table is empty
    tops = shared.materialise(subroots.join(sources, "tree").withColumn("root", F.lit(root.hash if root else None).cast("string")))
    named = every.join(small(tops, "source"), "tree")
    folded = F.aggregate("path", F.coalesce("other", "hash"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    out = named.select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), "other", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(manifest: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a proof as the hash of its siblings in order."""
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    return manifest.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
