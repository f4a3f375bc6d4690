"""Exact dedup of whole texts: Patricia-trie owners.

Texts are dealt out by length and content hash, and every task inserts the full byte strings of its buckets, one bucket
at a time, into a compressed radix trie. A terminal node holds the smallest identifier and the number of rows of its
text: it owns the group. Before the shuffle a task folds the copies it meets, so a text is sent once per FOLD_BYTES.

A trie is bounded by TRIE_BYTES. Beyond, its largest subtree is spilled: its texts, and later ones that lead into it, go
on as rows to a further round, dealt by another hash into more buckets. Every bucket settles one text at least in each
round. Texts of very many rows are salted in the first round and meet in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, shared

#: Distinct text a task holds to fold copies before it sends them.
FOLD_BYTES = 8 << 20
#: Distinct text in one trie.
TRIE_BYTES = 32 << 20
#: Buckets per shuffle partition; a task holds the trie of one of them.
SUB = 32
#: A text is hot if its rows hold more than so many bytes (and ROW_BYTES a row), and more than this share of all; there
#: are at most HOT_KEYS hot ones.
HOT_BYTES, HOT_KEYS = 4 << 20, 1_000_000
ROW_BYTES = 100

ENTRY = "bucket bigint, h bigint, data binary, low bigint, n bigint, last boolean"
OWNER = "h bigint, data binary, low bigint, n bigint, text_sha256 string"


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[bytes, list[int]]:
    """(bytes, offsets) of the texts with every run of white space as one space."""
    space = arrays.SPACE[buf]
    again = np.zeros(len(buf), bool)
    again[1:] = space[1:] & space[:-1]
    again[off[:-1][off[:-1] < len(buf)]] = False  # a text's first byte follows nothing
    return np.where(space, 32, buf).astype(np.uint8)[~again].tobytes(), np.concatenate([[0], np.cumsum(~again)])[off].tolist()


def content_hash(text: bytes, seed: int = 0) -> int:
    """64 bits of the text and its length, as a signed number."""
    return xxhash.xxh64_intdigest(text + len(text).to_bytes(8, "little"), seed) - (1 << 63)


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller identifier; null stands after every other."""
    return b if a is None else a if b is None else min(a, b)


class Node:
    """An edge, as a range of one of the inserted texts, and what it leads to."""

    __slots__ = ("ref", "start", "end", "kids", "owner")

    def __init__(self, ref: bytes, start: int, end: int):
        self.ref, self.start, self.end = ref, start, end
        self.kids: dict[int, Node | None] = {}  # by next byte; None: spilled
        self.owner: list | None = None  # [text, low, n, h, last] at the end of an inserted text


def common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], below ``most``, by doubling and halving."""
    low, step = 0, 16
    while low + step < most and a[i + low:i + low + step] == b[j + low:j + low + step]:
        low, step = low + step, step * 2
    high = min(low + step, most)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[i + low:i + mid] == b[j + low:j + mid] else (low, mid)
    return low if low < most and a[i + low:i + low + 1] != b[j + low:j + low + 1] else low + 1


class Trie:
    def __init__(self):
        self.root, self.n_bytes, self.n_owners = Node(b"", 0, 0), 0, 0

    def insert(self, text: bytes, low: int | None, n: int, h: int, last: bool) -> bool:
        """Add ``n`` rows of a text; False if it leads into a spilled subtree."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at], 0)
            if kid is None:
                return False
            if kid == 0:
                kid = node.kids[text[at]] = Node(text, at, len(text))
                node, at = kid, len(text)
                break
            k = kid.end - kid.start
            if text[at:at + k] == kid.ref[kid.start:kid.end]:
                node, at = kid, at + k
                continue
            m = common(text, at, kid.ref, kid.start, min(k, len(text) - at))
            fork = node.kids[text[at]] = Node(kid.ref, kid.start, kid.start + m)
            kid.start += m
            fork.kids[kid.ref[kid.start]] = kid
            node, at = fork, at + m
        if node.owner is None:
            node.owner = [text, low, n, h, last]
            self.n_bytes += len(text)
            self.n_owners += 1
        else:
            node.owner[1], node.owner[2] = smaller(node.owner[1], low), node.owner[2] + n
        return True

    def owners(self, node: Node | None = None) -> Iterator[list]:
        todo = [node or self.root]
        while todo:
            node = todo.pop()
            if node.owner is not None:
                yield node.owner
            todo.extend(k for k in node.kids.values() if k is not None)

    def spill(self) -> list[list]:
        """Take out the largest subtree of the first fork; nothing if only one text is held."""
        node = self.root
        while True:
            live = {b: k for b, k in node.kids.items() if k is not None}
            if len(live) + (node.owner is not None) != 1 or not live:
                break
            node = next(iter(live.values()))
        if not live:
            return []
        held = {b: list(self.owners(k)) for b, k in live.items()}
        most = max(held, key=lambda b: (sum(len(o[0]) for o in held[b]), b))
        node.kids[most] = None
        self.n_bytes -= sum(len(o[0]) for o in held[most])
        self.n_owners -= len(held[most])
        return held[most]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, row, size, h, text_sha256) of every row: th is a hash of the text as it is, row the row's number, the others are of the normalised text."""
    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            raw, at = normalised(buf, off)
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "th", "row")), pa.array(np.diff(at) + ROW_BYTES, pa.int64()), pa.array([content_hash(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "th", "row", "size", "h", "text_sha256"])

    rows = shared.texts(docs).select("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), "text")
    return shared.materialise(rows.mapInArrow(run, "doc_id bigint, th bigint, row bigint, size bigint, h bigint, text_sha256 string"))


def _entries(docs: DataFrame, hot: np.ndarray, buckets: int, salts: int, fold_bytes: int) -> DataFrame:
    """ENTRY rows: the distinct texts that a task meets within ``fold_bytes``, with their smallest id and number of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        from pyspark import TaskContext
        is_hot, salt, held, size = set(sent.value.tolist()), TaskContext.get().partitionId() % salts, {}, 0

        def flush():
            hashes = [content_hash(t) for t in held]
            bucket = [content_hash(b"%d" % h, 1 + (salt if h in is_hot else 0)) % buckets for h in hashes]
            cols = [bucket, hashes, list(held), [v[0] for v in held.values()], [v[1] for v in held.values()], [h not in is_hot for h in hashes]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["bucket", "h", "data", "low", "n", "last"])

        for rows, buf, off in arrays.chunks(batches):
            raw, at = normalised(buf, off)
            for a, b, low in zip(at[:-1], at[1:], rows.column("doc_id").to_pylist()):
                text = raw[a:b]
                if (own := held.get(text)) is None:
                    held[text] = [low, 1]
                    size += b - a + ROW_BYTES
                else:
                    own[0], own[1] = smaller(own[0], low), own[1] + 1
            if size > fold_bytes:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return shared.texts(docs).mapInArrow(run, ENTRY)


def _settle(entries: DataFrame, parts: int, trie_bytes: int) -> DataFrame:
    """OWNER rows of ENTRY rows: ``data`` is null where the text is settled, else it goes on to a further round."""
    def run(batches):
        trie, bucket, out = Trie(), None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["h", "data", "low", "n", "text_sha256"])

        def close():
            return [(h, None, low, n, hashlib.sha256(text).hexdigest()) if last else (h, text, low, n, None) for text, low, n, h, last in trie.owners()]

        for batch in batches:
            for b, h, text, low, n, last in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "data", "low", "n", "last"))):
                if b != bucket:
                    out += close()
                    trie, bucket = Trie(), b
                if not trie.insert(text, low, n, h, last):
                    out.append((h, text, low, n, None))
                while trie.n_bytes > trie_bytes and (gone := trie.spill()):
                    out += [(h, text, low, n, None) for text, low, n, h, _ in gone]
                if len(out) > 1000:
                    yield batch_of(out)
                    out = []
        out += close()
        if out:
            yield batch_of(out)

    return entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, OWNER)


def owners(docs: DataFrame, rows: DataFrame, fold_bytes: int = FOLD_BYTES, trie_bytes: int = TRIE_BYTES, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """((h, text_sha256, low, n) of every distinct text, (h) of the hot ones); ``rows`` are the fingerprints of ``docs``."""
    spark = docs.sparkSession
    total = rows.agg(F.sum("size").alias("b")).first().b or 0
    held = rows.groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") > max(hot_bytes, total // HOT_KEYS))
    hot = shared.materialise(held.select("h"))  # at most total / (total / HOT_KEYS) rows
    parts = shared.partitions(spark, total)
    entries = _entries(docs, np.array([r.h for r in hot.toLocalIterator()], np.int64), parts * SUB, int(parts ** 0.5) + 1, fold_bytes)
    found, turn = None, 0
    while True:
        out = shared.materialise(_settle(entries, parts, trie_bytes))
        done, left = out.where("data is null").select("h", "text_sha256", "low", "n"), out.where("data is not null")
        found = done if found is None else found.union(done)
        size = left.agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("b")).first()
        if not size.n:
            return found, hot
        turn += 1
        parts = shared.partitions(spark, size.b)
        bucket = F.pmod(F.xxhash64(F.lit(turn), "h"), F.lit(parts * SUB * 4 ** min(turn, 8)))
        entries = left.select(bucket.alias("bucket"), "h", "data", "low", "n", F.lit(True).alias("last"))


def copies(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, th, keep_id, group_size, kept, text_sha256), one row per row of (doc_id, text).

    Texts are equal when identical after every run of white space (0x20, 0x09-0x0D) has become one space; null counts as
    empty, and the empty text is a text like any other. Of a group the row with the smallest doc_id stays, a null doc_id
    only where there is no other; of rows that share that doc_id too, exactly one. ``th`` is a hash of the text as it is.
    Equality is decided by the bytes; a row finds its owner by 64 bits of content hash and the SHA-256. Other columns are ignored.
    """
    rows = fingerprints(docs)
    found, hot = owners(docs, rows, **limits)
    found = shared.materialise(found.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left").select(F.col("h").alias("g"), F.col("text_sha256").alias("s"), F.col("low").alias("keep_id"), F.col("n").alias("group_size"), F.coalesce("hot", F.lit(False)).alias("hot")))
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "h", "left")
    own = (F.col("h") == F.col("g")) & (F.col("text_sha256") == F.col("s"))
    # at most HOT_KEYS hot owners, whose many rows stay where they are
    named = marked.where("is_hot").join(F.broadcast(found.where("hot")), own).unionByName(marked.where("is_hot is null").join(found.where("not hot"), own))
    named = shared.materialise(named.select("doc_id", "th", "row", "h", "keep_id", "group_size", "text_sha256"))
    first = named.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h", "text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("stays"))
    out = named.join(first, "row", "left")
    return out.select("doc_id", "th", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), F.coalesce("stays", F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows alike in id and text one stays."""
    stays = copies(shared.texts(docs, id_col, text_col)).where("kept").select("doc_id", "th").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(f"`{id_col}`").cast("bigint").alias("i"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("t"))
    kept = own.join(stays, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left_semi")
    return kept.groupBy("i", "t").agg(F.first("record").alias("record")).select("record.*")
