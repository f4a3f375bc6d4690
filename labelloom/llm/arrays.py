"""Texts of many rows as flat numpy arrays: words, spans and rolling hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time inside a task, a little below a power of two as the tables of powers grow by doubling.
#: A longer single text is handled alone.
CHUNK_BYTES = (2 << 20) - 4096

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: 1 for every byte that begins a code point.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hash modulo 2^64 of any span, from one running sum.

    The values are random per symbol (bytes) or already mixed (word hashes), the base is an odd random number,
    so a power has an inverse and a span's hash is (sum up to its end - sum up to its start) / base^start.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.symbols = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._up[:n], out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self._down[start])


BYTES = Rolling(11)
WORDS = Rolling(13)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) in pieces of about ``limit`` bytes."""
    for batch in batches:
        buf, off = column_bytes(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a), buf[off[a]:off[b]], off[a:b + 1] - off[a]
            a = b


def deal(part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """(part int, rows binary): the rows of each part, packed, for a shuffle by part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    blobs = [rows[order[x:y]].tobytes() for x, y in zip(at, np.append(at[1:], len(part)))]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array(blobs, pa.binary())], ["part", "rows"])


def dealt(batches, kind: np.dtype) -> Iterator[np.ndarray]:
    """All rows of one part after another, from batches of (part, rows) in order of their parts."""
    held, part = [], None
    for batch in batches:
        for k, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
            if held and k != part:
                yield np.frombuffer(b"".join(held), kind)
                held = []
            part = k
            held.append(rows.as_py())
    if held:
        yield np.frombuffer(b"".join(held), kind)


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true bytes; no run crosses from one text into the next."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = off[:-1][off[1:] > off[:-1]]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:] = True, ~member[:-1]
    first[full] = True
    last[-1], last[:-1] = True, ~member[1:]
    last[full[1:] - 1] = True
    return np.flatnonzero(member & first), np.flatnonzero(member & last) + 1


def counts_in(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets of the items of each text: item i of text d has first[d] <= i < first[d + 1]."""
    return np.searchsorted(starts, off, "left")


def owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, width: int) -> np.ndarray:
    """Indices at which ``width`` consecutive items of one text start."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    i = np.arange(n)
    return i[i + width <= last]


def cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Boolean array of length n, true inside any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.subtract.at(d, end, 1)
    return np.cumsum(d[:-1]) > 0


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One fingerprint per segment: a bit is 1 if more than half of the segment's hashes have it."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    # eight running sums of eight 8-bit counters; segments are cut so that no counter overflows
    cuts = np.unique(np.concatenate([first, np.arange(0, len(hashes), 255)]))
    cuts = cuts[cuts < len(hashes)]
    into = np.searchsorted(first, cuts, "right") - 1
    ones = np.zeros((64, len(n)), np.int64)
    at = 0
    while at < len(cuts):  # as many at a time as a processor's cache holds
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + (1 << 16))))
        part = hashes[cuts[at]:cuts[end] if end < len(cuts) else len(hashes)]
        heads, own = cuts[at:end] - cuts[at], into[at:end]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        for j in range(8):
            lanes = np.add.reduceat((part >> np.uint64(j)) & np.uint64(0x0101010101010101), heads)
            for k in range(8):
                ones[8 * k + j, own[new]] += np.add.reduceat(((lanes >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.int64), new)
        at = end
    for b in range(64):
        out |= (2 * ones[b] > n).astype(np.uint64) << np.uint64(b)
    return out
