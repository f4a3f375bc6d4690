"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before every space that follows another character: no piece of a model with leading-space pieces reaches
over such a place, so the parts ("words") are encoded independently. The distinct words of a batch lie in one flat
symbol array. Each round finds the smallest pair rank of every word, merges it at its leftmost place (everywhere at
once where nothing that the merge creates could come first), and compacts, until no pair remains.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from labelloom.llm import arrays, shared

SPACE = "▁"
#: Words whose encoding a task remembers between batches.
CACHE_WORDS = 200_000
#: Symbols merged at a time.
SLICE = 1 << 16


class Model:
    """The tables of one model file; the library only reads the file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.vocab_size()
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = {names[i]: i for i in range(n) if not special[i]}
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:])):
            raise ValueError("a piece of this model reaches over the start of a word")
        # symbols: the pieces, then single characters that only occur inside pieces
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            symbol[c] = n + len(symbol) - len(normal)
        self.width = n + len(symbol) - len(normal)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = [(symbol[p[:k]] * self.width + symbol[p[k:]], rank[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair, self.rank, self.merged = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), pairs[:, 2].astype(np.int32)
        # a merge into piece p is safe everywhere at once if no pair that holds p comes before p itself
        parts = np.stack([self.pair // self.width, self.pair % self.width])
        own = np.full(self.width, np.iinfo(np.int64).max)
        own[:n] = np.where(special, own[:n], rank)
        self.unsafe = np.zeros(self.width, bool)
        for side in parts:
            self.unsafe[side[self.rank <= own[side]]] = True
        out = [b""] * self.width
        for p, i in symbol.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        out[self.unknown] = " \u2047 ".encode()
        self.bytes_of = out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; the largest integer where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair, key).clip(max=len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], np.iinfo(np.int32).max), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, offsets per word); words begin with their spaces and have no other."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        cps = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while a < len(words):  # slices that stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + SLICE, "right")) - 1)
            flat, n = self._merge(cps[begin[a]:begin[b]], sizes[a:b])
            ids.append(flat)
            counts.append(n)
            a = b
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _merge(self, cps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.iinfo(np.int32).max
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        sym = self.char[cps]
        sym = np.where(sym < 0, -1 - cps.astype(np.int32), sym)  # a character in no piece keeps its code point
        rank, into = np.full(len(sym), none, np.int32), np.zeros(len(sym), np.int32)  # of the pair that begins at each symbol
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], into[inner] = self.lookup(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            begins = np.ones(len(word), bool)
            np.not_equal(word[1:], word[:-1], out=begins[1:])
            least = np.minimum.reduceat(rank, np.flatnonzero(begins))
            seg = np.cumsum(begins, dtype=np.int32) - 1
            ended = least == none
            if ended.any():
                out = ended[seg]
                done.append((word[out], sym[out]))
                word, sym, rank, into = word[~out], sym[~out], rank[~out], into[~out]
                if not len(sym):
                    break
                least, seg = least[~ended], (np.cumsum(~ended) - 1)[seg[~out]]
            at = np.flatnonzero(rank == least[seg])
            of = seg[at]
            first = np.ones(len(at), bool)
            np.not_equal(of[1:], of[:-1], out=first[1:])
            # in a run of overlapping places (a a a a) every second one merges, from the left
            nth = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, nth, 0))
            head = np.maximum.accumulate(np.where(first, nth, 0))
            mixed = np.zeros(len(least), bool)  # words in which one rank stands for several pieces
            mixed[of[into[at] != into[at[head]]]] = True
            careful = self.unsafe[into[at]] | mixed[of]
            take = at[np.where(careful, first, (nth - run) % 2 == 0)]
            sym[take] = into[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            take = take - np.arange(len(take))  # where the merged symbols are after compaction
            word, sym, rank, into = word[keep], sym[keep], rank[keep], into[keep]
            changed = np.concatenate([take, take[take > 0] - 1])
            rank[changed] = none
            changed = changed[changed + 1 < len(sym)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], into[changed] = self.lookup(sym[changed], sym[changed + 1])
        if done:
            word, sym = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order].astype(np.int64)
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):  # a symbol that is no piece becomes the ids of its UTF-8 bytes
            raw = [self._fallback(int(x)) for x in sym[odd]]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            at = np.cumsum(times) - times
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            for p, r in zip(at[odd], raw):
                sym[p:p + len(r)] = r
        return sym, np.bincount(word, minlength=len(sizes))

    def _fallback(self, symbol: int) -> list[int]:
        raw = chr(-1 - symbol).encode() if symbol < 0 else self.bytes_of[symbol]
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: control ids vanish, the space put before the text is taken off, broken bytes become U+FFFD."""
        parts = [i for i in ids if self.bytes_of[i]]
        raw = b"".join([self.bytes_of[i] for i in parts])
        return raw.decode("utf-8", "each_byte") if parts[:1] == [self.unknown] else text_of(raw)


def text_of(raw: bytes) -> str:
    return raw.decode("utf-8", "each_byte").removeprefix(" ")


codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@functools.lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


WORD = re.compile(" *[^ ]+| +")


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces data[begin:begin + size], one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Strings:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, list[int]]:
        """(all strings of ids in one, where each of the groups off[i]:off[i + 1] begins and ends)."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return gather(self.data, self.begin[ids], size).tobytes(), at[off].tolist()


class Encoder:
    """Encodes texts of many batches, remembering words."""

    def __init__(self, path: str):
        self.model = load(path)
        self.digits = Strings([b"%d " % i for i in range(self.model.size)])
        self.bytes = Strings(self.model.bytes_of[:self.model.size])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # the empty word stands for the end id
        self.flat, self.off = np.array([self.model.end]), np.array([0, 1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text); every text closes with the end id."""
        words, count = [], []
        for t in texts:
            if t:
                words += WORD.findall(" " + t.replace(SPACE, " "))
            words.append("")
            count.append(len(words))
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = list(dict.fromkeys([w for w in words if w not in self.known]))
        if new:
            flat, off = self.model.encode_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.flat, self.off = np.concatenate([self.flat, flat]), np.concatenate([self.off, self.off[-1] + off[1:]])
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = (self.off[1:] - self.off[:-1])[slot]
        at = np.concatenate([[0], np.cumsum(size)])
        return gather(self.flat, self.off[slot], size), at[np.concatenate([[0], count]).astype(np.int64)]


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row per row of (doc_id, text).

    A null text counts as empty and has the end id alone. The model file is named by its path and must be installed on
    every executor. Repeated rows are encoded one by one; extra columns are ignored.
    """
    def run(batches):
        enc = Encoder(model)
        for rows, _, _ in arrays.chunks(batches):
            ids, off = enc.encode([t or "" for t in rows.column("text").to_pylist()])
            decimal, d = enc.digits.join(ids, off)
            raw, r = enc.bytes.join(ids, off)
            out = [rows.column("doc_id"), pa.array(np.diff(off)), pa.array([hashlib.sha256(decimal[a:b - 1]).hexdigest() for a, b in zip(d, d[1:])]),
                   pa.array([hashlib.sha256(text_of(raw[a:b]).encode()).hexdigest() for a, b in zip(r, r[1:])])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)
    return shared.texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
