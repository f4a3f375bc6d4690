"""The most frequent terms without shuffling every term: a mergeable summary, then exact counts.

``tfidf.term_stats`` sends each distinct n-gram of every partition through the exchange to keep a few thousand. Here the
first pass leaves one frequent-items sketch per partition and adds their lists up to a lower bound for each listed term
and one error for all; only terms whose upper bound reaches the k-th lower bound are counted in a second pass, in the
rows that hold the documents. What is shuffled is bounded by the sketches' size and the number of partitions. Where the
bounds do not separate the terms, the plain counts are used, so the result is exact in every case.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.operators import tfidf
from labelloom.session import materialise

#: Terms a sketch lists per term wanted, the least such list, terms it keeps per listed one, and Spark's own bounds.
LISTED_PER_TERM, MIN_LISTED, KEPT_PER_LISTED = 8, 1_000, 8
MAX_KEPT, MAX_LISTED = 1_000_000, 100_000


@dataclass
class Bounds:
    """(term, low): ``low`` <= frequency <= ``low + error``; a term that is not listed has at most ``error``."""

    lows: DataFrame
    error: int


def bounds(df: DataFrame, k: int, how: tfidf.Vectorizer = tfidf.Vectorizer()) -> Bounds | None:
    """Bounds of term frequencies from one sketch per partition; None if a sketch can name none of its terms.

    A sketch reports upper estimates, and none of its terms that it leaves out exceeds the least one it lists. So an
    estimate less that least one is a lower bound, and the least ones of all partitions sum up to the error.
    """
    listed = min(MAX_LISTED, max(MIN_LISTED, LISTED_PER_TERM * k))
    kept = min(MAX_KEPT, KEPT_PER_LISTED * listed)
    terms = tfidf.with_terms(df.select("text"), how=how).select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    sketches = terms.groupBy(F.spark_partition_id().alias("part")).agg(F.expr(f"approx_top_k_accumulate(term, {kept})").alias("sketch"))
    found = sketches.select("part", F.expr(f"approx_top_k_estimate(sketch, {listed})").alias("list"))
    least = F.array_min(F.transform("list", lambda x: x["count"]))
    lists = materialise(found.select(least.alias("least"), F.transform("list", lambda x: F.struct(x["item"].alias("term"), x["count"].alias("n"))).alias("list")))
    row = lists.agg(F.coalesce(F.sum("least"), F.lit(0)).alias("error"), F.count_if(F.col("least").isNull()).alias("mute")).first()
    if row.mute:
        return None
    each = lists.select("least", F.explode("list").alias("e")).groupBy("e.term").agg(F.sum(F.col("e.n") - F.col("least")).alias("low"))
    return Bounds(materialise(each), row.error)


def counted(df: DataFrame, terms: list[str], how: tfidf.Vectorizer = tfidf.Vectorizer()) -> DataFrame:
    """(term, ctf, df) of the given terms. They are counted inside each row, so the exchange holds sums of these alone."""
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_tf")
    rows = counter.transform(tfidf.with_terms(df.select("text"), how=how).select("terms")).select(F.unwrap_udt("_tf").alias("_s"))
    pairs = rows.select(F.explode_outer(F.arrays_zip(F.col("_s.indices").alias("i"), F.col("_s.values").alias("n"))).alias("_p")).where(F.col("_p").isNotNull())
    sums = pairs.groupBy(F.col("_p.i").alias("i")).agg(F.sum(F.col("_p.n").cast("bigint")).alias("ctf"), F.count(F.lit(1)).alias("df"))
    names = df.sparkSession.createDataFrame(pa.table({"i": pa.array(range(len(terms)), pa.int32()), "term": pa.array(terms, pa.string())}))
    return sums.join(names, "i").select("term", "ctf", "df")


def top_stats(df: DataFrame, k: int, min_df: int = 1, max_df: float = 1.0, how: tfidf.Vectorizer = tfidf.Vectorizer(),
              n_docs: int | None = None) -> DataFrame | None:
    """(term, ctf, df) of all terms that may be among the ``k`` most frequent within the limits, ties included.

    None where that cannot be told from the summary: fewer than ``k`` terms, bounds that overlap, candidates of more than
    MAX_BROADCAST_BYTES, or limits that leave fewer than ``k`` terms above the k-th lower bound.
    """
    limited = min_df > 1 or max_df < 1.0
    found = bounds(df, k, how)
    if found is None:
        return None
    band = tfidf.band_of(found.lows.withColumnRenamed("low", "ctf").where("ctf > 0"), 2 * k if limited else k)
    if band is None:
        return None
    level = found.lows.where(tfidf.band(F.col("low")) >= band).agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).first()
    if level.n < k or level.low <= found.error:
        return None
    chosen = found.lows.where(F.col("low") >= level.low - found.error).select("term")
    if chosen.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0] > settings.MAX_BROADCAST_BYTES:
        return None
    stats = materialise(counted(df, [r.term for r in chosen.orderBy("term").collect()], how))
    if limited:
        n_docs = df.count() if n_docs is None else n_docs
        sure = stats.where((F.col("ctf") >= level.low) & (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
        if sure.count() < k:
            return None
    return stats


def fit(df: DataFrame, max_features: int = settings.MAX_FEATURES, min_df: int = 1, max_df: float = 1.0,
        how: tfidf.Vectorizer = tfidf.Vectorizer()) -> tfidf.Tfidf:
    """The same model as ``tfidf.fit``, from the summary where its bounds allow and from the plain counts otherwise.

    Null and empty texts have no terms; a corpus without any gives an empty vocabulary. Use it where the distinct terms of
    a partition are many times ``max_features``; on a small corpus the first pass is mere cost.
    """
    n_docs = df.count()
    stats = top_stats(df, max_features, min_df, max_df, how, n_docs)
    if stats is None:
        stats = materialise(tfidf.term_stats(df, how))
    return tfidf.Tfidf.of(tfidf.vocabulary(stats, n_docs, max_features, min_df, max_df), how)
