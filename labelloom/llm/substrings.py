"""Substring dedup: Rabin-Karp hashes of every window of 20 words, counted in Spark, merged into removal intervals.

A window is sent to the task chosen by the smallest hash among its 4-word parts. Equal windows choose alike, and
neighbouring windows mostly choose alike too, so windows travel as runs: one document and start for about nine windows,
seven bytes of hash each. A chunk of documents sends each distinct window once, from its first place, however often it
has it; so no repeated passage, however common, fills a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, shared

WINDOW_WORDS = 20
PART_WORDS = 4
#: Bytes of text within which each distinct window is sent once.
CHUNK_BYTES = 4 << 20
#: Buckets per shuffle partition; a task sorts one bucket at a time.
SUB = 8
RUN = np.dtype([("doc", "<i8"), ("th", "<u4"), ("start", "<u4"), ("n", "u1")])
HASH_BYTES = 7

CUTS = "doc_id bigint, th int, starts array<int>, ends array<int>"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows under one id are told apart by 32 bits of a hash of the text."""
    return shared.texts(docs).select("doc_id", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int").alias("th"), "text")


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def intervals(start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows at the given ascending starts."""
    if not len(start):
        return start, start
    cut = np.flatnonzero(start[1:] > start[:-1] + width) + 1
    return start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])] + width


def cut_rows(doc: np.ndarray, th: np.ndarray, null: np.ndarray, start: np.ndarray, width: int) -> list[tuple]:
    """(doc_id, th, starts, ends) from windows to remove, ordered by document and start."""
    if not len(doc):
        return []
    edge = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (null[1:] != null[:-1])) + 1, [len(doc)]])
    rows = []
    for a, b in zip(edge[:-1], edge[1:]):
        s, e = intervals(start[a:b], width)
        rows.append((None if null[a] else int(doc[a]), int(th[a]), s.tolist(), e.tolist()))
    return rows


#: Stands for a null id in packed runs, before every other id.
NULL_ID = np.iinfo(np.int64).min


def repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """CUTS of (doc_id, th, text): word intervals covered by windows that start earlier too; several rows per document."""
    spark = docs.sparkSession
    n_bytes = shared.text_bytes(docs)
    parts = shared.partitions(spark, n_bytes)  # about a byte and a half is sent for every byte of text
    buckets = parts * SUB

    def scatter(batches):
        for rows, _, _ in arrays.chunks(batches, limit=CHUNK_BYTES):
            ids = rows.column("doc_id").fill_null(NULL_ID)
            table = pa.table([ids, rows.column("th"), rows.column("text")], ["doc", "th", "text"]).sort_by([("doc", "ascending"), ("th", "ascending")])
            doc, th = (table.column(c).to_numpy() for c in ("doc", "th"))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])  # a repeated row is the same document
            if not new.all():
                table = table.filter(pa.array(new))
                doc, th = doc[new], th[new]
            buf, off = arrays.column_bytes(table.column("text"))
            begin, end = arrays.spans(~arrays.SPACE[buf], off)
            first = arrays.counts_in(off, begin)
            words = arrays.BYTES.span(arrays.BYTES.sums(arrays.BYTES.symbols[buf]), begin, end)
            win = arrays.windows(first, window)
            if not len(win):
                continue
            sums = arrays.WORDS.sums(words)
            h = arrays.WORDS.span(sums, win, win + window)
            part = np.arange(len(words) - PART_WORDS + 1)
            bucket = (smallest(arrays.WORDS.span(sums, part, part + PART_WORDS), window - PART_WORDS + 1)[win] % np.uint64(buckets)).astype(np.int64)
            owner = arrays.owners(first)[win]
            start = win - first[owner]
            order = np.argsort(h, kind="stable")
            later = np.zeros(len(h), bool)
            later[order[1:]] = h[order[1:]] == h[order[:-1]]
            out = [(-1 - int(abs(d or 0) % parts), d, t, s, e, None) for d, t, s, e in cut_rows(doc[owner[later]], th[owner[later]], doc[owner[later]] == NULL_ID, start[later], window)]
            sent = np.flatnonzero(~later)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            b, o, s = bucket[sent], owner[sent], start[sent]
            head = np.ones(len(sent), bool)
            head[1:] = (b[1:] != b[:-1]) | (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
            at = np.flatnonzero(head)
            at = np.unique(np.concatenate([at, *[at_ + np.arange(255, n, 255) for at_, n in zip(at, np.diff(np.append(at, len(sent)))) if n > 255]])) if len(at) else at
            runs = np.zeros(len(at), RUN)
            runs["doc"], runs["th"], runs["start"], runs["n"] = doc[o[at]], th[o[at]], s[at], np.diff(np.append(at, len(sent)))
            packed = h[sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
            edge = np.flatnonzero(np.diff(b[at], prepend=-1))
            for x, y in zip(edge, np.append(edge[1:], len(at))):
                lo, hi = at[x], at[y] if y < len(at) else len(sent)
                out.append((int(b[at[x]]), None, None, None, None, np.int64(y - x).tobytes() + runs[x:y].tobytes() + packed[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()))], ["bucket", "doc_id", "th", "starts", "ends", "data"])

    def settle(blobs):
        runs, hashes = [], []
        for raw in blobs:
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            runs.append(np.frombuffer(raw, RUN, n, 8))
            hashes.append(np.frombuffer(raw, np.uint8, -1, 8 + n * RUN.itemsize).reshape(-1, HASH_BYTES))
        runs, raw = np.concatenate(runs), np.concatenate(hashes)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :HASH_BYTES] = raw
        h = wide.view("<u8").ravel()
        n = runs["n"].astype(np.int64)
        which = np.repeat(np.arange(len(runs)), n)
        doc, th = runs["doc"][which], runs["th"][which]
        start = runs["start"][which].astype(np.int64) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        # only hashes that occur twice or more are put in order
        order = np.argsort(h)
        s = h[order]
        twin = np.zeros(len(s), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:]
        pick = order[twin]
        pick = pick[np.lexsort((start[pick], th[pick], doc[pick], h[pick]))]
        h, doc, th, start = h[pick], doc[pick], th[pick], start[pick]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        f = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        later = (doc != doc[f]) | (th != th[f]) | (start != start[f])
        doc, th, start = doc[later], th[later], start[later]
        by = np.lexsort((start, th, doc))
        return cut_rows(doc[by], th[by], doc[by] == NULL_ID, start[by], window)

    def gather(batches):
        held, bucket = [], None

        def rows_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["doc_id", "th", "starts", "ends"])
        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("data")))
            if known.num_rows:
                yield known.select(["doc_id", "th", "starts", "ends"])
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if not raw.is_valid:
                    continue
                if held and b != bucket:
                    if rows := settle(held):
                        yield rows_of(rows)
                    held = []
                bucket = b
                held.append(raw.as_py())
        if held and (rows := settle(held)):
            yield rows_of(rows)

    sent = docs.mapInArrow(scatter, "bucket int, doc_id bigint, th int, starts array<int>, ends array<int>, data binary")
    return sent.repartition(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(gather, CUTS)


def dedup_windows(docs: DataFrame, window: int = WINDOW_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, starts, ends, kept]) for every row of (doc_id, text).

    Every word is removed that lies in a window of ``window`` words whose sequence also starts earlier: in a document of a
    smaller doc_id (null first), or earlier in the same document. ``starts`` and ``ends`` are the maximal removal intervals
    in words, ``kept`` the words left, joined by one space. Texts that are null, empty or shorter than a window lose
    nothing. Different texts under one doc_id are ordered by a hash of the text; rows alike in both are one document and
    get the same result. Windows are compared by 56 bits of hash within a bucket chosen by other bits. Other columns are ignored.
    """
    rows = keyed(docs)
    cuts = repeats(rows, window).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    cuts = cuts.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "starts", "ends")
    joined = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left").select("doc_id", "text", "starts", "ends")

    def finish(batches):
        for part, buf, off in arrays.chunks(batches):
            raw, out = buf.tobytes(), []
            for a, b, s, e in zip(off[:-1].tolist(), off[1:].tolist(), part.column("starts").to_pylist(), part.column("ends").to_pylist()):
                words = raw[a:b].split()
                gone, n = np.zeros(len(words), bool), len(words)
                if s:
                    gone = arrays.cover(np.array(s), np.array(e), n)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                row = (n, int(gone.sum()), hashlib.sha256(kept).hexdigest())
                if with_text:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    row += (edge[::2].tolist(), edge[1::2].tolist(), kept.decode())
                out.append(row)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends", "kept"][:4 + 3 * with_text])

    return joined.mapInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", starts array<int>, ends array<int>, kept string" if with_text else ""))
