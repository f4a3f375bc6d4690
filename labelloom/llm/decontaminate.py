"""Benchmark decontamination over a positional inverted index of the training tokens.

The index is a table of segments. A segment covers about 2 MB of text and holds its sorted term dictionary with one
list of word positions per term. A test phrase is searched from its rarest terms: the rarest term's list, moved by the
term's offset in the phrase, gives candidate starts, and every further term's list, moved likewise, is intersected with
them. Terms are 64-bit hashes of lower-cased words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, shared
from labelloom.session import shared_dir

WINDOW = 10
#: Benchmark text searched in one pass over the index; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20

INDEX = ("segment string, doc_ids array<bigint>, first binary, terms binary, counts binary, postings binary, n_postings bigint")


def _deltas(x: np.ndarray) -> bytes:
    """Non-negative integers below 2^35 as little-endian groups of seven bits."""
    x = x.astype(np.uint64)
    size = 1 + sum((x >= (1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = np.flatnonzero(size > k)
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((x[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def _undelta(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = np.flatnonzero(first + k <= last)
        out[has] |= (b[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def term_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words)."""
    low = arrays.LOWER[buf]
    start, end = arrays.spans(arrays.ALNUM[low], off)
    sums = arrays.BYTES.sums(arrays.BYTES.symbols[low])
    return arrays.BYTES.span(sums, start, end), arrays.counts_in(off, start)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the positional index of (doc_id, text) to ``path`` (default: the shared folder) and read it back."""
    path = path or f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"

    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            h, first = term_hashes(buf, off)
            order = np.argsort(h, kind="stable")
            terms, at, counts = np.unique(h[order], return_index=True, return_counts=True)
            gaps = np.diff(order, prepend=0)
            gaps[at] = order[at]  # each list begins anew
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([first.astype(np.int64).tobytes()]),
                pa.array([terms.tobytes()]), pa.array([_deltas(counts)]), pa.array([_deltas(gaps)]), pa.array([len(h)])],
                ["segment", "doc_ids", "first", "terms", "counts", "postings", "n_postings"])

    shared.texts(docs).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Phrases:
    """Distinct phrases of a block of test items, by width, with the items each belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        found: dict[bytes, set[int]] = {}
        self.items = [None if i is None else str(i) for i, _ in items]
        col = pa.array([t for _, t in items], pa.string())
        h, first = term_hashes(*arrays.column_bytes(col))
        for k in range(len(items)):
            words = h[first[k]:first[k + 1]]
            for s in range(max(1, len(words) - window + 1)) if len(words) else ():
                found.setdefault(words[s:s + window].tobytes(), set()).add(k)
        self.owners = list(found.values())
        self.width = np.array([len(k) // 8 for k in found], np.int64)
        self.words = np.zeros((len(found), window), np.uint64)
        for r, k in enumerate(found):
            self.words[r, :len(k) // 8] = np.frombuffer(k, np.uint64)
        self.terms = np.unique(self.words[np.arange(window)[None, :] < self.width[:, None]])
        self.index = np.searchsorted(self.terms, self.words).clip(max=max(0, len(self.terms) - 1))
        self.order = None

    def by_rarity(self, counts: np.ndarray) -> None:
        """Fix each phrase's word order: rarest first, over the whole corpus."""
        rank = counts[self.index] if len(self.terms) else np.zeros(self.index.shape)
        rank = np.where(np.arange(self.words.shape[1])[None, :] < self.width[:, None], rank, np.iinfo(np.int64).max)
        self.order = np.argsort(rank, axis=1, kind="stable")


def blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """The test items in pieces of about ``limit`` bytes, so that what is shipped to tasks has a bound."""
    held, size = [], 0
    for row in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        size += 64 + len((row[1] or "").encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Segment:
    """One row of the index, unpacked; lists of test terms only."""

    def __init__(self, first: bytes, terms: bytes, counts: bytes, postings: bytes | None, wanted: np.ndarray):
        self.first = np.frombuffer(first, np.int64)
        t, n = np.frombuffer(terms, np.uint64), _undelta(counts)
        at = np.searchsorted(t, wanted).clip(max=max(0, len(t) - 1))
        here = (t[at] == wanted) if len(t) else np.zeros(len(wanted), bool)
        self.count = np.where(here, n[at] if len(n) else 0, 0)
        if postings is None:
            return
        gaps = _undelta(postings)
        begin = np.concatenate([[0], np.cumsum(n)])
        total = np.cumsum(gaps)
        # positions restart with every list
        before = np.concatenate([[0], total])[begin[:-1]]
        pos = total - np.repeat(before, n)
        self.size = int(self.first[-1]) + 1
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        rows = np.repeat(np.arange(len(wanted)), self.count)
        take = np.repeat(begin[at] if len(t) else np.zeros(len(wanted), np.int64), self.count) + np.arange(len(rows)) - self.start[rows]
        self.pos = pos[take] if len(take) else np.zeros(0, np.int64)
        self.keys = rows * self.size + self.pos  # ascending: lists in term order, positions in order

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (which, position) of the given terms' lists."""
        n = self.count[term]
        which = np.repeat(np.arange(len(term)), n)
        return which, self.pos[np.repeat(self.start[term], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]

    def phrase_hits(self, q: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, document) of every exact occurrence."""
        inside = np.arange(q.words.shape[1])[None, :] < q.width[:, None]
        alive = np.flatnonzero(((self.count[q.index] > 0) | ~inside).all(1)) if len(q.width) else np.zeros(0, np.int64)
        at = q.order[alive, 0] if len(alive) else alive
        which, pos = self.lists(q.index[alive, at]) if len(alive) else (alive, alive)
        phrase, start = alive[which], pos - at[which] if len(alive) else pos
        doc = np.searchsorted(self.first, pos, "right") - 1
        ok = (start >= self.first[doc]) & (start + q.width[phrase] <= self.first[doc + 1]) if len(pos) else np.zeros(0, bool)
        phrase, start, doc = phrase[ok], start[ok], doc[ok]
        for k in range(1, q.words.shape[1]):
            if not len(phrase):
                break
            at = q.order[phrase, k]
            key = q.index[phrase, at] * self.size + start + at
            i = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            ok = (self.keys[i] == key) | (k >= q.width[phrase])
            phrase, start, doc = phrase[ok], start[ok], doc[ok]
        return phrase, start, doc

    def near(self, term: np.ndarray, within: int) -> np.ndarray:
        """Documents in which every one of the terms lies within so many words of the first one."""
        if not (self.count[term] > 0).all():
            return np.zeros(0, np.int64)
        _, pos = self.lists(term[:1])
        doc = np.searchsorted(self.first, pos, "right") - 1
        low, high = np.maximum(self.first[doc], pos - within), np.minimum(self.first[doc + 1] - 1, pos + within)
        ok = np.ones(len(pos), bool)
        for t in term[1:]:
            i = np.searchsorted(self.keys, t * self.size + low)
            ok &= (i < len(self.keys)) & (self.keys[i.clip(max=len(self.keys) - 1)] <= t * self.size + high)
        return np.unique(doc[ok])


def _rarity(index: DataFrame, q: Phrases) -> np.ndarray:
    """Occurrences of each test term in the whole corpus: one number per term of the block."""
    wanted = index.sparkSession.sparkContext.broadcast(q.terms)

    def run(batches):
        for b in batches:
            n = sum((Segment(f, t, c, None, wanted.value).count for f, t, c in zip(*(b.column(k).to_pylist() for k in ("first", "terms", "counts")))), np.zeros(len(wanted.value), np.int64))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], ["term", "n"])

    out = np.zeros(len(q.terms), np.int64)
    for r in index.select("first", "terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


HITS = "segment string, row int, starts array<bigint>, ends array<bigint>, items array<string>"


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Exact phrase matches: (segment, row, starts, ends, items), one row per document that has any and per block of items."""
    spark, out = index.sparkSession, None
    for block in blocks(items, id_col, text_col):
        q = Phrases(block, window)
        if not len(q.terms):
            continue
        q.by_rarity(_rarity(index, q))
        sent = spark.sparkContext.broadcast(q)

        def run(batches, sent=sent):
            q = sent.value
            for b in batches:
                for seg, *parts in zip(*(b.column(k).to_pylist() for k in ("segment", "first", "terms", "counts", "postings"))):
                    phrase, start, doc = Segment(*parts, q.terms).phrase_hits(q)
                    order = np.argsort(doc, kind="stable")
                    phrase, start, doc = phrase[order], start[order], doc[order]
                    cut = np.concatenate([np.unique(doc, return_index=True)[1], [len(doc)]])
                    rows = []
                    for s, e in zip(cut[:-1], cut[1:]):
                        which = set().union(*(q.owners[p] for p in set(phrase[s:e].tolist())))
                        spans = np.unique(np.stack([start[s:e], start[s:e] + q.width[phrase[s:e]]], 1), axis=0)
                        rows.append((seg, int(doc[s]), spans[:, 0].tolist(), spans[:, 1].tolist(), sorted({q.items[k] for k in which} - {None})))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())))], ["segment", "row", "starts", "ends", "items"])

        hits = index.select("segment", "first", "terms", "counts", "postings").mapInArrow(run, HITS)
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], HITS)


def proximity(index: DataFrame, items: DataFrame, within: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id string): documents in which all words of the item lie within ``within`` words of an occurrence of its rarest word."""
    spark, out = index.sparkSession, None
    for block in blocks(items, id_col, text_col):
        q = Phrases(block, 1)
        if not len(q.terms):
            continue
        count = _rarity(index, q)
        per_item: dict[int, list[int]] = {}
        for r, own in enumerate(q.owners):
            for k in own:
                per_item.setdefault(k, []).append(int(q.index[r, 0]))
        wanted = {k: np.array(sorted(v, key=lambda t: count[t])) for k, v in per_item.items()}
        sent = spark.sparkContext.broadcast((q, wanted))

        def run(batches, sent=sent):
            q, wanted = sent.value
            for b in batches:
                for ids, *parts in zip(*(b.column(k).to_pylist() for k in ("doc_ids", "first", "terms", "counts", "postings"))):
                    seg = Segment(*parts, q.terms)
                    rows = [(ids[d], q.items[k]) for k, terms in wanted.items() for d in seg.near(terms, within)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "item_id"])

        found = index.select("doc_ids", "first", "terms", "counts", "postings").mapInArrow(run, "doc_id bigint, item_id string")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id string")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of (doc_id, text).

    A null or empty text has no words and is clean; rows repeated under one doc_id each get their own row; items without
    words, and an empty item table, match nothing; an item whose id is null marks words but is not listed. Other columns
    are ignored.
    """
    index = build_index(docs)
    hits = search(index, items, window, id_col, text_col).groupBy("segment", "row").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def covered(batches):
        for b in batches:
            n = []
            for s, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist()):
                s, e = np.array(s), np.array(e)
                n.append(int(arrays.cover(s - s.min(), e - s.min(), int(e.max() - s.min())).sum()))
            yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("row"), pa.array(n, pa.int64()), b.column("items")], ["segment", "row", "n_hit", "items"])

    hits = hits.mapInArrow(covered, "segment string, row int, n_hit bigint, items array<string>").alias("h")

    def listed(batches):
        for b in batches:
            for seg, ids, first in zip(*(b.column(k).to_pylist() for k in ("segment", "doc_ids", "first"))):
                n = np.diff(np.frombuffer(first, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([seg] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(n)], ["segment", "row", "doc_id", "n_words"])

    rows = index.select("segment", "doc_ids", "first").mapInArrow(listed, "segment string, row int, doc_id bigint, n_words bigint")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits, ["segment", "row"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` of whose doc_id no row is contaminated."""
    bad = contamination(docs, items).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id), "left_anti")
