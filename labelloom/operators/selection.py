"""Feature selection and the guard on terms that must survive it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.operators import tfidf


def chi2_scores(df: DataFrame, model: tfidf.Tfidf, num_classes: int = settings.NUM_CLASSES) -> DataFrame:
    """(term, idx, score): weight per class against its expectation under the class shares.

    The per-class sums are columns of one aggregate per term, so no term x class grid is
    joined; a term is at most ``num_classes`` numbers per task before the shuffle.
    """
    classes = range(num_classes)
    shares = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("label") == c).alias(f"n{c}") for c in classes]).first()
    weights = tfidf.long_weights(df, model, ["label"])
    sums = weights.groupBy("idx").agg(F.sum("weight").alias("total"), *[
        F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"o{c}")
        for c in classes])
    expected = [F.lit(shares[f"n{c}"] / shares["n"]) * F.col("total") for c in classes]
    parts = [F.try_divide((F.col(f"o{c}") - expected[c]) * (F.col(f"o{c}") - expected[c]), expected[c])
             for c in classes]
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    vocab = model.vocab.select("idx", "term")
    # Both sides have at most one row per vocabulary entry.
    return sums.join(vocab, "idx").select("term", "idx", F.round(score, 6).alias("score"))


def chi2_select(scores: DataFrame, k: int = settings.CHI2_TOP_K) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.desc("term")).limit(k)


def guard_terms(variants: DataFrame, terms: list[str]) -> DataFrame:
    """(variant, term, kept) for every variant and guard term. ``variants`` is (variant, term)."""
    found = variants.groupBy("variant").agg(*[
        F.max(F.col("term") == t).alias(f"g{i}") for i, t in enumerate(terms)])
    return found.select("variant", F.inline(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"g{i}").alias("kept")) for i, t in enumerate(terms)])))


def decide(results: DataFrame, baseline: str, min_delta: float = settings.PROMOTE_DELTA) -> DataFrame:
    """One row: the best variant by macro-F1 and whether to promote it over the baseline.

    ``results`` is (variant, position, macro_f1); equal scores go to the lower position.
    """
    best = results.agg(
        F.max_by("variant", F.struct("macro_f1", -F.col("position"))).alias("winner"),
        F.max("macro_f1").alias("best_f1"),
        F.max(F.when(F.col("variant") == baseline, F.col("macro_f1"))).alias("baseline_f1"))
    delta = F.col("best_f1") - F.col("baseline_f1")
    return best.select("winner", F.round("best_f1", 6).alias("best_f1"),
                       F.round("baseline_f1", 6).alias("baseline_f1"), F.round(delta, 6).alias("delta"),
                       F.when(delta > min_delta, "promote").otherwise("keep").alias("decision"))
