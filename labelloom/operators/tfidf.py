"""TF-IDF: fit on long-form term counts, transform row by row.

Fit counts where the documents are: tasks code the tokens of a slice of documents as numbers, count
their runs as arrays, and shuffle one sum per term and slice, so no text is shuffled. Transform needs no shuffle either: the
vocabulary is bounded by ``max_features`` and lives in a Spark ML ``CountVectorizerModel``. Above
a measured size it stays a table that the terms are joined with.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import settings
from labelloom.functions import arrays as ar
from labelloom.functions import chars
from labelloom.functions import text as tx
from labelloom.operators import skew
from labelloom.session import materialise

# Bytes of one idf value in the array that is shipped with the terms.
IDF_BYTES = 20
# Tokens that a task counts at a time, in whole documents.
SLICE_TOKENS = 1 << 21
# Bytes of text whose terms meet in one partition.
PARTITION_BYTES = 8 * 1024 * 1024

VOCAB_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("idx", T.IntegerType()),
    T.StructField("ctf", T.LongType()), T.StructField("df", T.LongType()),
    T.StructField("idf", T.DoubleType()), T.StructField("n_docs", T.LongType()),
])


@dataclass(frozen=True)
class Vectorizer:
    """How a text becomes terms, and a term count a weight."""

    ngram_range: tuple[int, int] = (1, 2)
    token_pattern: str = chars.TOKEN
    sublinear_tf: bool = True

    def tf(self, count: Column) -> Column:
        return 1 + F.log(count) if self.sublinear_tf else count.cast("double")


def with_terms(df: DataFrame, out: str = "terms", how: Vectorizer = Vectorizer()) -> DataFrame:
    """Add the array of n-grams. Tokens get a column of their own so that the regular
    expression runs once per document."""
    return (df.withColumn("_tokens", tx.tokens(F.col("text"), how.token_pattern))
              .withColumn(out, tx.ngrams(F.col("_tokens"), *how.ngram_range)).drop("_tokens"))


def _levels(tokens: pa.ListArray, least: int, most: int):
    """(rows, codes, names) per length of n-gram: the row and the code of each, and the string of each code."""
    off = tokens.offsets.to_numpy()
    row = np.repeat(np.arange(len(tokens)), np.diff(off))
    coded = tokens.flatten().dictionary_encode()
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    at, names, out = word, words, []
    for n in range(1, most + 1):
        if n > 1:
            whole = np.flatnonzero(row[:-(n - 1)] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
            keys, found = np.unique(at[whole] * max(1, len(words)) + word[whole + n - 1], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(keys // max(1, len(words))), words.take(keys % max(1, len(words))), " ")
            at = np.full(len(word), -1)
            at[whole] = found
        if n >= least:
            out.append((row[at >= 0], at[at >= 0], names))
    if len(out) > 1 and pc.any(pc.match_substring(words, " ")).as_py():  # then terms of two lengths may be equal
        first = np.cumsum([0] + [len(names) for *_, names in out])
        every = pa.concat_arrays([names for *_, names in out]).dictionary_encode()
        same = every.indices.to_numpy()
        out = [(np.concatenate([r for r, *_ in out]), np.concatenate([same[k + at] for k, (_, at, _) in zip(first, out)]), every.dictionary)]
    return out


def _slices(batches):
    """The batches, those with many tokens in parts of whole rows."""
    for b in batches:
        off = b.column("_tokens").offsets.to_numpy()
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_TOKENS, "right")) - 1)
            yield b.slice(a, z - a)
            a = z


def _tokens(df: DataFrame, how: Vectorizer, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in keep], tx.tokens(F.col("text"), how.token_pattern).alias("_tokens"))


def partitions_for(df: DataFrame) -> int:
    """Partitions for the terms of (text), PARTITION_BYTES of text each: a task's memory does not grow with the table."""
    return max(2, -(-(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION_BYTES))


def _row_counts(df: DataFrame, keep: list[str], how: Vectorizer) -> DataFrame:
    """(row_id, *keep, term, tf) as counted inside each row, without a shuffle; rows that share a row_id are not merged."""
    held = df.select("row_id", *keep).schema
    schema = T.StructType([*held, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    how_many, columns = how.ngram_range, held.names

    def run(batches):
        for b in _slices(batches):
            for row, at, names in _levels(b.column("_tokens"), *how_many):
                pairs, n = np.unique(row * max(1, len(names)) + at, return_counts=True)
                which = pa.array(pairs // max(1, len(names)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(which) for c in columns), names.take(pa.array(pairs % max(1, len(names)))), pa.array(n)], [*columns, "term", "tf"])
    return _tokens(df, how, columns).mapInArrow(run, schema)


def term_counts(df: DataFrame, keep: list[str] | None = None, how: Vectorizer = Vectorizer()) -> DataFrame:
    """(row_id, *keep, term, tf), rows of one row_id counted together."""
    keep = keep or []
    counted = _row_counts(df, keep, how).repartition(partitions_for(df), "row_id")
    return counted.groupBy("row_id", *keep, "term").agg(F.sum("tf").alias("tf"))


def token_frequency(df: DataFrame) -> DataFrame:
    """(term, ctf) of single tokens, for callers that need no document counts."""
    long = df.select(F.explode_outer(tx.tokens(F.col("text"))).alias("term"))
    return (long.where(F.col("term").isNotNull()).groupBy("term")
                .agg(F.count(F.lit(1)).alias("ctf")))


def term_stats(df: DataFrame, how: Vectorizer = Vectorizer()) -> DataFrame:
    """(term, ctf, df): corpus and document frequency, counted where the documents are.

    Each task sums up slices of SLICE_TOKENS before anything is shuffled; the sums of a term then meet in one of
    as many partitions as the texts' bytes ask for.
    """
    def run(batches):
        for b in _slices(batches):
            for row, at, names in _levels(b.column("_tokens"), *how.ngram_range):
                held = np.sort(row * max(1, len(names)) + at)  # quicker than np.unique, which hashes
                codes = held[np.diff(held, prepend=-1) > 0] % max(1, len(names))
                yield pa.RecordBatch.from_arrays([names, *(pa.array(np.bincount(c, minlength=len(names))) for c in (at, codes))], ["term", "ctf", "df"])
    counted = _tokens(df, how, []).mapInArrow(run, "term string, ctf bigint, df bigint")
    return counted.repartition(partitions_for(df), "term").groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def band(ctf: Column) -> Column:
    return F.floor(F.log2(ctf) * 8)


def band_of(stats: DataFrame, k: int) -> int | None:
    """The lowest band of ``ctf`` that the ``k`` terms of highest ``ctf`` reach into; None without terms."""
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    return (stats.groupBy(band(F.col("ctf")).alias("band")).agg(F.count(F.lit(1)).alias("n"))  # a few hundred bands
            .withColumn("_above", F.coalesce(F.sum("n").over(above), F.lit(0)))
            .where(F.col("_above") < k).agg(F.min("band")).first()[0])


def most_frequent(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of highest ``ctf``, ties to the lower term; ``stats`` is a stored table.

    A top-k merges k rows of every partition in one task. Terms that cannot qualify are
    left out before: counts per band of ``ctf`` show the lowest band that is still needed.
    """
    needed = band_of(stats, k)
    if needed is not None:
        stats = stats.where(band(F.col("ctf")) >= needed)
    return stats.orderBy(F.desc("ctf"), F.asc("term")).limit(k)


def vocabulary(stats: DataFrame, n_docs: int, max_features: int = settings.MAX_FEATURES,
               min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """The most frequent terms within the document-frequency limits, columns numbered in
    term order. Ties at the cut go to the lower term. The window runs over at most
    ``max_features`` rows, after the limit."""
    allowed = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    top = most_frequent(allowed, max_features)
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df")).cast("double")) + 1
    return top.select("term", idx.cast("int").alias("idx"), "ctf", "df", idf.alias("idf"),
                      F.lit(n_docs).cast("long").alias("n_docs"))


@dataclass
class Tfidf:
    """A fitted vocabulary: a bounded table, plus what the transform ships to the tasks."""

    vocab: DataFrame
    size: int
    n_bytes: int
    n_docs: int
    how: Vectorizer = Vectorizer()

    @classmethod
    def of(cls, vocab: DataFrame, how: Vectorizer = Vectorizer()) -> "Tfidf":
        stored = materialise(vocab)
        row = stored.agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("d"),
                         F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
        return cls(stored, row.n, row.b + row.n * IDF_BYTES, row.d or 0, how)

    @property
    def shippable(self) -> bool:
        return self.n_bytes <= settings.MAX_BROADCAST_BYTES

    @cached_property
    def counter(self) -> tuple[CountVectorizerModel, Column]:
        """The term counter and the idf array: at most ``max_features`` rows of checked size."""
        if not self.shippable:
            raise ValueError(f"a vocabulary of {self.n_bytes} bytes is above MAX_BROADCAST_BYTES ({settings.MAX_BROADCAST_BYTES}): "
                             "a stream has to be scored batch by batch (streaming.score does)")
        rows = self.vocab.orderBy("idx").select("term", "idf").collect()
        counter = CountVectorizerModel.from_vocabulary(
            [r.term for r in rows], inputCol="_terms", outputCol="_tf")
        return counter, ar.double_array([r.idf for r in rows])

    def select_terms(self, chosen: DataFrame) -> "Tfidf":
        """Keep the terms of ``chosen``; idf stays, columns are renumbered in term order."""
        idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
        kept = self.vocab.join(chosen.select("term"), "term", "left_semi")
        return Tfidf.of(kept.withColumn("idx", idx.cast("int")).select(*VOCAB_SCHEMA.names), self.how)

    def save(self, path: str) -> None:
        how = json.dumps([list(self.how.ngram_range), self.how.token_pattern, self.how.sublinear_tf])
        self.vocab.withColumn("how", F.lit(how)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Tfidf":
        """Raises when nothing was saved at ``path``."""
        stored = spark.read.parquet(path)
        head = stored.select("how").first()
        ngrams, pattern, sublinear = json.loads(head.how) if head else ([1, 2], chars.TOKEN, True)
        return cls.of(stored.select(*VOCAB_SCHEMA.names), Vectorizer(tuple(ngrams), pattern, sublinear))


def fit(df: DataFrame, max_features: int = settings.MAX_FEATURES, min_df: int = 1,
        max_df: float = 1.0, how: Vectorizer = Vectorizer()) -> Tfidf:
    """Fit on training documents only."""
    stats = materialise(term_stats(df, how))
    return Tfidf.of(vocabulary(stats, df.count(), max_features, min_df, max_df), how)


def weights_by_join(df: DataFrame, model: Tfidf, keep: list[str] | None = None) -> DataFrame:
    """(row_id, *keep, term, idx, weight) for a vocabulary of any size.

    Only a vocabulary of checked size is broadcast; a larger one is joined on the term,
    with frequent terms salted by their document frequency.
    """
    keep = keep or []
    counts = _row_counts(df, keep, model.how)
    if model.shippable:
        found = counts.join(F.broadcast(model.vocab.select("term", "idx", "idf")), "term")
    else:
        found = skew.rows_of_groups(counts, model.vocab, ["term"], "df", carry=["idx", "idf"])
    # terms outside the vocabulary are gone before the rows of a document meet
    met = found.repartition(partitions_for(df), "row_id").groupBy("row_id", *keep, "term", "idx", "idf").agg(F.sum("tf").alias("tf"))
    raw = met.withColumn("_w", model.how.tf(F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("row_id")))
    return raw.select("row_id", *keep, "term", "idx", (F.col("_w") / norm).alias("weight"))


def transform(df: DataFrame, model: Tfidf) -> DataFrame:
    """Add ``indices`` and ``weights`` (tf, smoothed idf, unit length) to each row.

    Unknown terms are ignored; a document without any known term gets empty arrays. Up to
    MAX_BROADCAST_BYTES of vocabulary this is a projection for tables and streams alike; beyond,
    a table goes through :func:`transform_by_join` and a stream raises a ValueError.
    """
    if not model.size:
        return df.withColumn("indices", F.array().cast("array<int>")).withColumn(
            "weights", F.array().cast("array<double>"))
    if not model.shippable and not df.isStreaming:
        return transform_by_join(df, model)
    counter, idf = model.counter
    counted = counter.transform(with_terms(df, "_terms", model.how)).withColumn("_s", F.unwrap_udt("_tf"))
    raw = F.zip_with(F.col("_s.values"), F.col("_s.indices"),
                     lambda tf, i: model.how.tf(tf) * F.get(idf, i))
    return (counted.withColumn("indices", F.col("_s.indices")).withColumn("_raw", raw)
                   .withColumn("weights", ar.l2_normalise(F.col("_raw")))
                   .drop("_terms", "_tf", "_s", "_raw"))


def transform_by_join(df: DataFrame, model: Tfidf) -> DataFrame:
    """:func:`transform` for a vocabulary of any size, with texts only in the map stages.

    The rows are stored under an id of their own, so that input rows may repeat and need no
    key; what is gathered again per row is one document's distinct terms.
    """
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    weights = weights_by_join(rows.select(F.col("_row").alias("row_id"), "text"), model)
    entries = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    found = weights.groupBy("row_id").agg(entries.alias("_e")).withColumnRenamed("row_id", "_id")
    none = {"indices": "array<int>", "weights": "array<double>"}
    parts = {"indices": "_e.idx", "weights": "_e.weight"}
    return rows.join(found, F.col("_row") == F.col("_id"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.col(parts[c]), F.array().cast(t)).alias(c) for c, t in none.items()])


def with_vectors(df: DataFrame, model: Tfidf, out: str = "features") -> DataFrame:
    """Add the sparse ML vector of each row."""
    return (transform(df, model)
            .withColumn(out, ar.sparse_vector(model.size, F.col("indices"), F.col("weights")))
            .drop("indices", "weights"))


def long_weights(df: DataFrame, model: Tfidf, keep: list[str] | None = None) -> DataFrame:
    """(row_id, *keep, idx, weight) from the row-wise transform."""
    zipped = F.arrays_zip(F.col("indices").alias("idx"), F.col("weights").alias("weight"))
    return (transform(df, model).withColumn("_z", zipped)
            .select("row_id", *(keep or []), F.explode_outer("_z").alias("_e"))
            .where(F.col("_e").isNotNull())
            .select("row_id", *(keep or []), F.col("_e.idx").alias("idx"), F.col("_e.weight").alias("weight")))


def density(df: DataFrame, model: Tfidf) -> DataFrame:
    """Rows, vocabulary size, stored weights and filled share of the feature matrix."""
    counted = transform(df, model).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum(F.size("indices")).cast("long").alias("nnz"))
    return counted.select("n_rows", F.lit(model.size).cast("long").alias("vocab_size"), "nnz",
                          F.round(F.col("nnz") * 100.0 / (F.col("n_rows") * F.lit(model.size)), 6)
                          .alias("density_pct"))


def vocab_sample(vocab: DataFrame, k: int = 15, seed: int = settings.SEED) -> DataFrame:
    """A seeded sample of ``k`` vocabulary entries."""
    return vocab.orderBy(tx.seeded_key(F.col("term"), seed), "term").limit(k).select("idx", "term")


def compare_tokenizers(df: DataFrame) -> DataFrame:
    """Token counts under the script-aware class and the plain word class, per document."""
    both = (df.withColumn("_ours", tx.tokens(F.col("text")))
              .withColumn("_plain", tx.tokens(F.col("text"), chars.PLAIN_TOKEN)))
    return both.select("row_id", F.size("_ours").alias("script_tokens"),
                       F.size("_plain").alias("plain_tokens"),
                       F.size(F.array_distinct("_ours")).alias("script_distinct"),
                       F.size(F.array_distinct("_plain")).alias("plain_distinct"))
