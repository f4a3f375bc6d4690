"""Phrase collocations by SETM relational mining.

The occurrence relation of phrases of k words is a stored table, sorted by piece and position: one row per block of text,
with flat arrays of places and of local phrase numbers. Group-counting its phrases gives the frequent ones; the
occurrences of frequent phrases (a semi-join) are merge-joined with themselves at adjacent places, which gives the
relation of k + 1 words. Pieces never cross blocks, so only counts are shuffled: the tables are bucketed by block and
stay where they are. Phrases are compared as strings, counts are exact.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import arrays, buckets, shared
from labelloom.session import shared_dir

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text of a bucket of the stored tables, which one task holds.
BUCKET_BYTES = 8 << 20
#: Frequent phrases are broadcast up to so many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

#: places and codes are compressed int32 arrays in order of the places: phrase ``codes[i]`` of ``phrases`` starts at word
#: ``places[i]`` of the block; there is a place without a word between two pieces. ``counts`` are those of ``phrases``, ``n`` is their sum.
RELATION = "block bigint, lang string, n bigint, places binary, codes binary, phrases array<string>, counts array<int>"


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.astype("<i4").tobytes())


def places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64))


def codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4")


def row(block: int, lang: str, at: np.ndarray, code: np.ndarray, phrases: pa.Array) -> pa.RecordBatch:
    n = np.bincount(code, minlength=len(phrases)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([lang]), pa.array([len(code)], pa.int64()), pa.array([packed(np.diff(at, prepend=0))]), pa.array([packed(code)]),
        pa.ListArray.from_arrays(pa.array([0, len(phrases)], pa.int32()), phrases), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n))],
        ["block", "lang", "n", "places", "codes", "phrases", "counts"])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(places, codes, distinct words) of the lower-cased texts' words; texts, like pieces, leave a place free between them."""
    buf, off = arrays.column_bytes(column)
    low = arrays.LOWER[buf]
    begin, end = arrays.spans(~GAP[low], off)
    if not len(begin):
        return begin, begin.astype(np.int32), pa.array([], pa.string())
    breaks = np.concatenate([[0], np.cumsum(BREAK[low])])
    text = np.searchsorted(off, begin, "right")
    apart = (breaks[begin[1:]] != breaks[end[:-1]]) | (text[1:] != text[:-1])
    at = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(apart)])
    inside = ~GAP[low]
    sizes = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(low[inside].tobytes())).dictionary_encode()
    return at, words.indices.to_numpy().astype(np.int32), words.dictionary.cast(pa.string())


class Relation:
    """An occurrence relation stored as a table that is bucketed by block."""

    def __init__(self, rows: DataFrame, buckets: int, moved: bool = False):
        """``moved``: the rows do not yet lie by block."""
        self.spark, self.name = rows.sparkSession, f"occurrences_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        rows = rows.repartition(buckets, "block") if moved else rows
        rows.write.bucketBy(buckets, "block").sortBy("block").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def single_words(docs: DataFrame) -> DataFrame:
    """RELATION rows of all words of (text, lang); a block holds texts of one language."""
    def run(batches):
        for rows, _, _ in arrays.chunks(batches, limit=BLOCK_BYTES):
            langs = rows.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                at, code, words = words_of(rows.column("text").filter(pc.equal(langs.indices, k)))
                if len(at):
                    yield row(uuid.uuid4().int >> 65, lang, at, code, words)

    return docs.select("text", "lang").mapInArrow(run, RELATION)


def extended(relation: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """RELATION rows of k + 1 words from those of k: occurrences of frequent phrases joined with those at the next place.

    ``frequent`` is (block, good): the block's phrase numbers that are frequent.
    """
    def run(batches):
        for b in batches:
            # one block at a time: only its own arrays are unpacked
            for block, lang, at, code, good, phrases in zip(*(b.column(c) for c in ("block", "lang", "places", "codes", "good", "phrases"))):
                block, lang, at, code = block.as_py(), lang.as_py(), places(at.as_py()), codes(code.as_py())
                keep = np.zeros(len(phrases.values), bool)
                keep[good.values.to_numpy(zero_copy_only=False)] = True
                stays = keep[code]
                at, code = at[stays], code[stays].astype(np.int64)
                # both sides are in order of the places, so equal places are found by one pass
                left = np.flatnonzero(at[1:] == at[:-1] + 1)
                if not len(left):
                    continue
                pair, new = np.unique(code[left] << 32 | code[left + 1], return_inverse=True)
                first, second = phrases.values.take(pa.array(pair >> 32)), phrases.values.take(pa.array(pair & 0xFFFFFFFF))
                if k > 1:
                    second = pc.replace_substring_regex(second, r"^.* ", "")
                yield row(block, lang, at[left], new, pc.binary_join_element_wise(first, second, " "))

    joined = relation.join(frequent, "block").select("block", "lang", "places", "codes", "phrases", "good")
    return joined.mapInArrow(run, RELATION)


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table with a phrase column, with a broadcast hint if its measured size allows it."""
    size = df.agg(F.sum(F.octet_length("phrase") + 64).alias("b")).first().b or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): all phrases of up to ``max_words`` words that occur ``min_count`` times or more
    in their language, and the number of words of each language."""
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    parts = shared.partitions(spark, shared.text_bytes(own), BUCKET_BYTES)
    relation, out = Relation(single_words(own), parts, moved=True), None
    shared.free_shuffles(spark)
    totals = shared.materialise(relation.rows.groupBy("lang").agg(F.sum("n").alias("n")))
    for k in range(1, max_words + 1):
        entries = relation.rows.select("block", "lang", F.posexplode(F.arrays_zip("phrases", "counts")).alias("code", "e")).select("block", "lang", "code", F.col("e.phrases").alias("phrase"), F.col("e.counts").alias("n"))
        # counted by 32 bits of hash first: a sum below min_count rules out all its phrases, so only the others' strings are sent
        entries = entries.withColumn("h", F.hash("lang", "phrase"))
        likely = shared.materialise(entries.groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).select("h"))
        likely = entries.join(buckets.small(likely), "h", "left_semi")
        level = shared.materialise(likely.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).withColumn("words", F.lit(k)))
        out = level if out is None else out.union(level)
        if k == max_words or level.isEmpty():
            break
        # collect_list leaves nulls out: the codes of infrequent phrases
        known = small(level).select("lang", "phrase", F.lit(True).alias("known"))
        found = entries.join(known, ["lang", "phrase"], "left").groupBy("block").agg(F.collect_list(F.when(F.col("known"), F.col("code"))).alias("good"))
        longer = Relation(extended(relation.rows, found, k), parts)
        relation.drop()
        relation = longer
        del entries, likely, known, found
        shared.free_shuffles(spark)
    relation.drop()
    return out, totals


def joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of several words, for its lowest-scoring cut, the first of equals."""
    parts = small(phrases).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    cuts = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(parts.withColumnsRenamed({"of": f"of_{name}", "part": f"part_{name}", "f": name}), (F.col("lang") == F.col(f"of_{name}")) & (F.col(part) == F.col(f"part_{name}")))
    cuts = cuts.join(totals, "lang").withColumn("score", score("a", "l", "r", "n"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def score(a: str, l: str, r: str, n: str) -> Column:
    """floor(1000 * a * n / (l * r)) of counts below 10^16, exactly: the products have 38 digits at most."""
    a, l, r, n = (f"cast({c} as decimal(16, 0))" for c in (a, l, r, n))
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {a} * {n}) div ({l} * {r})")


def swallowed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase): phrases whose words lie inside a longer frequent phrase that occurs as often."""
    def inside(w: Column) -> Column:
        n = F.size(w)
        return F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: joined(w, i, m))))
    subs = phrases.where("words > 2").select("lang", "f", F.explode(F.array_distinct(inside(F.split("phrase", " ")))).alias("phrase"))
    most = subs.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= 100 * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``max_words`` words (null: all).

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and 0x0A-0x0D, and those into words at spaces and tabs.
    ``a`` counts all occurrences of a phrase within pieces, overlaps included; phrases of fewer than ``min_count`` are no
    candidates. A cut after k words gives l and r, the counts of both parts, and floor(1000 a n / (l r)), n being all words
    of the language; the lowest such score counts, of equals the first cut. A candidate inside a longer candidate of the
    same count goes. Order: score and a descending, phrase ascending bytewise. A null text is empty, a null language
    ``und``; repeated rows count as often as they come; an empty table gives no row. Other columns are ignored.
    """
    found, totals = frequent_phrases(docs, min_count, max_words, text_col, lang_col)
    best = shared.materialise(scored(found, totals).join(swallowed(found), ["lang", "phrase"], "left_anti"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language's ranking starts in parts, so that no task holds all its phrases
        salts = int((best.count() / top) ** 0.5) + 1
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
