"""Suffix-array dedup of long byte strings: difference-cover blockwise construction.

A difference cover D modulo v is a set of residues such that for any two positions i and j some offset below v moves both
into D. The strings of L - v bytes at cover positions are ranked first (by hash; only repeated ones matter). If two
strings of L bytes are equal, so are the ranks at their common cover offset: suffixes without a repeated rank near them
have no partner and need no sorting. The others are dealt into buckets by content, and one bucket at a time is sorted by
the first v and the last v bytes of each string; ties are resolved by the cover ranks, which stand for all bytes between.

Texts are packed once into blocks of about 2 MB, whose numbers are what tasks and answers refer to. The blocks are a
table bucketed by that number, so answers join them without moving them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, shared
from labelloom.llm.substrings import intervals, smallest
from labelloom.session import shared_dir

LENGTH = 200
PERIOD = 91
#: A perfect difference set modulo 91: every non-zero difference occurs exactly once.
COVER = np.array([0, 1, 3, 9, 27, 49, 56, 61, 77, 81])
#: Bytes kept of a cover string's hash, besides its bucket, to find out whether it repeats.
SAMPLE_BYTES = 5
#: Bytes whose hashes choose a suffix's bucket: so many that no run of them is common in a language, else its bucket would
#: hold as large a share of all suffixes whatever the number of buckets.
GRAM = 32
SUB = 8
#: Bytes of text of which a task makes keys at a time, and suffixes of a bucket that it sorts at a time.
KEY_BYTES, SORT_ROWS = 4 << 20, 1 << 21

IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[COVER] = True
#: Cover positions below each position of one period.
BELOW = np.concatenate([[0], np.cumsum(IN_COVER)])
#: OFFSET[a, b]: the offset that moves residues a and b both into the cover.
OFFSET = np.zeros((PERIOD, PERIOD), np.int64)
for _a in range(PERIOD):
    for _b in range(PERIOD):
        OFFSET[_a, _b] = next(k for k in range(PERIOD) if IN_COVER[(_a + k) % PERIOD] and IN_COVER[(_b + k) % PERIOD])

#: Bytes of text in a block; a longer text has a block of its own.
BLOCK_BYTES = 2 << 20

BLOCKS = "block bigint, doc_ids array<bigint>, off binary, data binary"
RUN = np.dtype([("block", "<i8"), ("at", "<i4"), ("local", "<i4"), ("n", "<i4")])


def covers_below(local: np.ndarray) -> np.ndarray:
    """Cover positions before a position of a text."""
    return local // PERIOD * len(COVER) + BELOW[local % PERIOD]


def pack(docs: DataFrame) -> DataFrame:
    """The texts as a stored table of compressed blocks, bucketed by block."""
    spark = docs.sparkSession

    def run(batches):
        z = zstandard.ZstdCompressor(3)
        for rows, buf, off in arrays.chunks(batches, limit=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().int >> 65]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([off.astype(np.int64).tobytes()]), pa.array([z.compress(buf.tobytes())])], ["block", "doc_ids", "off", "data"])
    name = f"text_blocks_{uuid.uuid4().hex}"
    buckets = shared.partitions(spark, shared.text_bytes(shared.texts(docs)))
    (shared.texts(docs).mapInArrow(run, BLOCKS).write.bucketBy(buckets, "block").sortBy("block")
     .option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def suffix_buckets(sums: np.ndarray, start: np.ndarray, length: int, buckets: int) -> np.ndarray:
    """The bucket of each suffix by its content: the smallest hash of GRAM bytes within ``length``."""
    at = np.arange(len(sums) - GRAM)
    return (smallest(arrays.BYTES.span(sums, at, at + GRAM), length - GRAM + 1)[start] % np.uint64(buckets)).astype(np.int64)


def unpack(off: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.frombuffer(off, np.int64)


class Samples:
    """Cover strings of a block: where they are, their ranks, and their distinct ranks by bucket."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, sums: np.ndarray, buckets: int, length: int):
        width = length - PERIOD
        size = np.diff(off)
        n = covers_below(np.maximum(size - width + 1, 0))
        doc = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        self.at = off[doc] + nth // len(COVER) * PERIOD + COVER[nth % len(COVER)]
        self.rank = arrays.BYTES.span(sums, self.at, self.at + width)
        self.unique, self.inverse, self.times = np.unique(self.rank, return_inverse=True, return_counts=True)
        # distinct ranks ordered by bucket; within one by value
        bucket = (self.unique % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        self.short = (self.unique // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SAMPLE_BYTES]


def _repeated_samples(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """(block, bucket, seen binary): for each of the block's distinct ranks in the bucket a bit, set if another block has it."""
    def scatter(batches):
        for b in batches:
            for block, off, data in zip(*(b.column(c).to_pylist() for c in ("block", "off", "data"))):
                buf, off = unpack(off, data)
                s = Samples(buf, off, arrays.BYTES.sums(arrays.BYTES.symbols[buf]), parts, length)
                full = np.flatnonzero(np.diff(s.cuts)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([s.short[s.order[s.cuts[k]:s.cuts[k + 1]]].tobytes() for k in full], pa.binary())], ["block", "bucket", "ranks"])

    def gather(batches):
        held: dict[int, list] = {}

        def answers(bucket, rows):
            raw = [np.frombuffer(r, np.uint8).reshape(-1, SAMPLE_BYTES) for _, r in rows]
            size = np.array([len(r) for r in raw])
            wide = np.zeros((size.sum(), 8), np.uint8)
            wide[:, :SAMPLE_BYTES] = np.concatenate(raw)
            key = wide.view("<u8").ravel()
            order = np.argsort(key)
            s, seen = key[order], np.zeros(len(key), bool)
            twin = s[1:] == s[:-1]
            seen[order[1:][twin]] = True
            seen[order[:-1][twin]] = True
            at = np.concatenate([[0], np.cumsum(size)])
            some = [k for k in range(len(rows)) if seen[at[k]:at[k + 1]].any()]
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.int64()), pa.array([bucket] * len(some), pa.int32()), pa.array([np.packbits(seen[at[k]:at[k + 1]]).tobytes() for k in some], pa.binary())], ["block", "bucket", "seen"])

        for b in batches:
            for block, bucket, ranks in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "ranks"))):
                if held and bucket not in held:  # rows come in order of their buckets
                    (k, rows), = held.items()
                    yield answers(k, rows)
                    held = {}
                held.setdefault(bucket, []).append((block, ranks))
        for k, rows in held.items():
            yield answers(k, rows)

    sent = blocks.select("block", "off", "data").mapInArrow(scatter, "block bigint, bucket int, ranks binary")
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "block bigint, bucket int, seen binary")


def _suffix_repeats(blocks: DataFrame, seen: DataFrame, parts: int, length: int, tasks: int) -> DataFrame:
    """(block, starts, ends): intervals of a block's bytes covered by strings that occur twice; several rows per block."""
    buckets = tasks * SUB

    def scatter(batches):
        for b in batches:
            for block, off, data, told in zip(*(b.column(c).to_pylist() for c in ("block", "off", "data", "told"))):
                buf, off = unpack(off, data)
                sums = arrays.BYTES.sums(arrays.BYTES.symbols[buf])
                s = Samples(buf, off, sums, parts, length)
                twice = s.times > 1
                for t in told or ():
                    mine = s.order[s.cuts[t["bucket"]]:s.cuts[t["bucket"] + 1]]
                    twice[mine] |= np.unpackbits(np.frombuffer(t["seen"], np.uint8), count=len(mine)).astype(bool)
                at = s.at[twice[s.inverse]]
                near = arrays.cover(np.maximum(at - PERIOD + 1, 0), at + 1, len(buf)) if len(at) else np.zeros(len(buf), bool)
                size = np.diff(off)
                room = np.repeat(off[1:], size) - np.arange(len(buf)) >= length
                start = np.flatnonzero(near & room)
                if not len(start):
                    continue
                # strings that the block itself has twice are known to go, and the block sends one of them
                h = arrays.BYTES.span(sums, start, start + length)
                order = np.argsort(h, kind="stable")
                again = np.zeros(len(h), bool)
                twin = h[order[1:]] == h[order[:-1]]
                again[order[1:][twin]] = True
                known = again.copy()
                known[order[:-1][twin]] = True
                x, y = intervals(start[known], length)
                out = [(-1 - block % tasks, block, x.tolist(), y.tolist(), None)] if len(x) else []
                start = start[~again]
                doc = np.searchsorted(off, start, "right") - 1
                bucket = suffix_buckets(sums, start, length, buckets)
                head = np.ones(len(start), bool)
                head[1:] = (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
                i = np.flatnonzero(head)
                n = np.diff(np.append(i, len(start)))
                runs = np.zeros(len(i), RUN)
                runs["block"], runs["at"], runs["local"], runs["n"] = block, start[i], start[i] - off[doc[i]], n
                # ranks at the cover positions within v bytes of any start of the run; positions are in order
                lo, hi = np.searchsorted(s.at, start[i]), np.searchsorted(s.at, start[i] + n - 1 + PERIOD)
                rank32 = s.rank.astype(np.uint32)
                by = np.argsort(bucket[i], kind="stable")
                edge = np.flatnonzero(np.diff(bucket[i][by], prepend=-1))
                raw = buf.tobytes()
                for a, c in zip(edge, np.append(edge[1:], len(by))):
                    pick = by[a:c]
                    text = b"".join([raw[p:p + k + length - 1] for p, k in zip(start[i[pick]].tolist(), n[pick].tolist())])
                    ranks = np.concatenate([rank32[p:q] for p, q in zip(lo[pick], hi[pick])])
                    out.append((int(bucket[i[pick[0]]]), None, None, None, np.array([len(pick), len(ranks)], np.int64).tobytes() + runs[pick].tobytes() + ranks.tobytes() + text))
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "block", "starts", "ends", "data"])

    def keys(blobs):
        """(runs, ranks, key of every suffix) of some packed runs: a hash of its first and its last bytes."""
        runs, ranks, text = [], [], []
        for raw in blobs:
            k, r = np.frombuffer(raw, np.int64, 2).tolist()
            runs.append(np.frombuffer(raw, RUN, k, 16))
            ranks.append(np.frombuffer(raw, np.uint32, r, 16 + k * RUN.itemsize))
            text.append(np.frombuffer(raw, np.uint8, -1, 16 + k * RUN.itemsize + 4 * r))
        runs, ranks, text = map(np.concatenate, (runs, ranks, text))
        n = runs["n"].astype(np.int64)
        at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (length - 1), n)
        sums = arrays.BYTES.sums(arrays.BYTES.symbols[text])
        ends = arrays.BYTES.span(sums, at + length - PERIOD, at + length)
        return runs, ranks, arrays.mix(arrays.BYTES.span(sums, at, at + PERIOD) + arrays.mix(ends + np.uint64(1)))

    def sort_bucket(blobs):
        """(block, starts) of each blob's strings that have an equal one in the bucket.

        Beside the texts, 8 bytes of key stay in memory for a suffix; the rest is made for KEY_BYTES or SORT_ROWS at a time.
        """
        begin = np.cumsum([0] + [len(x) for x in blobs]) // KEY_BYTES
        edge = np.flatnonzero(np.diff(begin[:-1], prepend=-1)).tolist()
        made = [keys(blobs[a:c]) for a, c in zip(edge, [*edge[1:], len(blobs)])]
        runs, ranks, key = map(np.concatenate, zip(*made))
        del made
        n, local = runs["n"].astype(np.int64), runs["local"].astype(np.int64)
        first = np.cumsum(n) - n
        counts = covers_below(local + n - 1 + PERIOD) - covers_below(local)
        base = np.cumsum(counts) - counts - covers_below(local)
        equal = np.zeros(len(key), bool)
        slices = -(-len(key) // SORT_ROWS)
        for j in range(slices):
            mine = np.flatnonzero(key % np.uint64(slices) == j)
            order = mine[np.argsort(key[mine])]
            same = key[order[1:]] == key[order[:-1]]
            tied = np.zeros(len(order), bool)
            tied[1:][same] = True
            tied[:-1][same] = True
            left = order[tied]  # in key order
            run = np.searchsorted(first, left, "right") - 1
            pos, at = local[run] + left - first[run], base[run]
            while len(left):  # one turn per distinct string that shares its first and last v bytes with others
                g = np.ones(len(left), bool)
                g[1:] = key[left[1:]] != key[left[:-1]]
                lead = np.maximum.accumulate(np.where(g, np.arange(len(left)), 0))
                d = OFFSET[pos % PERIOD, pos[lead] % PERIOD]
                match = ranks[at + covers_below(pos + d)] == ranks[at[lead] + covers_below(pos[lead] + d)]
                hit = match & ~g
                equal[left[hit]] = True
                equal[left[lead[hit]]] = True
                left, pos, at = left[~match], pos[~match], at[~match]
        of = np.cumsum([0] + [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs])  # a blob's runs are in order of their starts
        for a, c in zip(of[:-1].tolist(), of[1:].tolist()):
            found = first[a] + np.flatnonzero(equal[first[a]:first[c - 1] + n[c - 1]])
            run = np.searchsorted(first, found, "right") - 1
            if len(found):
                yield int(runs["block"][a]), runs["at"][run] + found - first[run]

    def gather(batches):
        held, bucket = [], None

        def flush():
            rows = []
            for block, start in sort_bucket(held):
                x, y = intervals(start, length)
                rows.append((block, x.tolist(), y.tolist()))
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["block", "starts", "ends"])] if rows else []

        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("data")))
            if known.num_rows:
                yield known.select(["block", "starts", "ends"])
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if not raw.is_valid:
                    continue
                if held and b != bucket:
                    yield from flush()
                    held = []
                bucket = b
                held.append(raw.as_py())
        if held:
            yield from flush()

    told = seen.groupBy("block").agg(F.collect_list(F.struct("bucket", "seen")).alias("told"))
    sent = blocks.select("block", "off", "data").join(told, "block", "left").mapInArrow(scatter, "bucket int, block bigint, starts array<int>, ends array<int>, data binary")
    return sent.repartition(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket").mapInArrow(gather, "block bigint, starts array<int>, ends array<int>")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row of (doc_id, text).

    Every byte of the UTF-8 text goes that is covered by a string of ``length`` bytes which also starts at any other
    place of the table. Null counts as empty; texts shorter than ``length`` lose nothing; repeated rows are documents of
    their own and so empty each other. Strings are compared by 64 bits of hash of their first and last bytes and a
    32-bit rank of what lies between. Other columns are ignored.
    """
    if length <= PERIOD:
        raise ValueError(f"length must exceed the cover's period {PERIOD}")
    blocks = pack(docs)
    spark = docs.sparkSession
    n_bytes = blocks.agg(F.sum(F.octet_length("data")).alias("n")).first().n or 0
    parts = shared.partitions(spark, 2 * n_bytes, 8 << 20)
    cuts = _suffix_repeats(blocks, _repeated_samples(blocks, parts, length), parts, length, shared.partitions(spark, 2 * n_bytes))
    cuts = cuts.groupBy("block").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def finish(batches):
        for b in batches:
            for ids, off, data, s, e in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "off", "data", "starts", "ends"))):
                buf, off = unpack(off, data)
                gone = arrays.cover(np.array(s), np.array(e), len(buf)) if s else np.zeros(len(buf), bool)
                runs = arrays.counts_in(off, arrays.spans(gone, off)[0])
                kept = np.concatenate([[0], np.cumsum(~gone)])[off]
                raw = buf[~gone].tobytes()
                texts = [raw[x:y] for x, y in zip(kept.tolist(), kept[1:].tolist())]
                out = [pa.array(ids, pa.int64()), pa.array(np.diff(off)), pa.array(np.diff(off) - np.diff(kept)), pa.array(np.diff(runs).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    out, names = [*out, pa.array(texts, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(out, names)

    return blocks.join(cuts, "block", "left").mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
