"""Feature-filter variants: vocabulary, guard term and scores of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import arrays as ar
from labelloom.operators import linear, metrics, selection, tfidf
from labelloom.session import materialise

BASELINE = "baseline"
MAX_DF = "max_df"
MAX_MIN_DF = "max_df_min_df"
CHI2 = "chi2"
VARIANTS = [BASELINE, MAX_DF, MAX_MIN_DF, CHI2]


def fit_variants(train: DataFrame, max_features: int = settings.MAX_FEATURES, max_df: float = 0.9,
                 min_df: int = 2, top_k: int = settings.CHI2_TOP_K) -> dict[str, tfidf.Tfidf]:
    """One vocabulary per variant. Term statistics are counted once for all of them."""
    stats = materialise(tfidf.term_stats(train))
    n = train.count()
    models = {
        BASELINE: tfidf.Tfidf.of(tfidf.vocabulary(stats, n, max_features)),
        MAX_DF: tfidf.Tfidf.of(tfidf.vocabulary(stats, n, max_features, max_df=max_df)),
        MAX_MIN_DF: tfidf.Tfidf.of(tfidf.vocabulary(stats, n, max_features, min_df, max_df)),
    }
    scores = selection.chi2_scores(train, models[BASELINE])
    models[CHI2] = models[BASELINE].select_terms(selection.chi2_select(scores, top_k))
    return models


def variant_terms(models: dict[str, tfidf.Tfidf]) -> DataFrame:
    """(variant, position, term) of all variants."""
    parts = [m.vocab.select(F.lit(name).alias("variant"), F.lit(i).alias("position"), "term")
             for i, (name, m) in enumerate(models.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vocab_table(models: dict[str, tfidf.Tfidf], guard: str = settings.GUARD_TERM) -> DataFrame:
    """(variant, vocab_size, has_guard)."""
    return variant_terms(models).groupBy("variant").agg(
        F.count(F.lit(1)).alias("vocab_size"), F.max(F.col("term") == guard).alias("has_guard"))


def run(train: DataFrame, test: DataFrame, models: dict[str, tfidf.Tfidf],
        guard: str = settings.GUARD_TERM, c: float = settings.FIXED_C) -> DataFrame:
    """(variant, position, accuracy, macro_f1, vocab_size, has_guard) at one fixed C.

    The selection variant keeps the baseline's unit-length weights of the chosen terms, so
    its vectors are the baseline's with the other columns left out.
    """
    rows = []
    base = models[BASELINE]
    for position, (name, model) in enumerate(models.items()):
        if name == CHI2:
            tr, te = (_restricted(df, base, model) for df in (train, test))
        else:
            tr, te = (tfidf.with_vectors(df, model) for df in (train, test))
        fitted = linear.fit(linear.training_table(tr.select("label", "features")), c)
        scored = linear.predict(te.select("label", "features"), fitted)
        flat = metrics.flat_metrics(metrics.confusion_record(scored)).first()
        rows.append((name, position, flat.accuracy, flat.macro_f1))
    scores = train.sparkSession.createDataFrame(
        rows, "variant string, position int, accuracy double, macro_f1 double")
    return scores.join(vocab_table(models, guard), "variant")


def _restricted(df: DataFrame, base: tfidf.Tfidf, chosen: tfidf.Tfidf) -> DataFrame:
    """Baseline weights of the chosen terms only, in the chosen numbering."""

    pairs = (base.vocab.select("term", F.col("idx").alias("old"))
             .join(chosen.vocab.select("term", F.col("idx").alias("new")), "term", "left"))
    renumber = [r.new if r.new is not None else -1
                for r in pairs.orderBy("old").select("new").collect()]  # <= max_features numbers
    mapping = F.from_json(F.lit(str(renumber)), "array<int>")
    kept = (tfidf.transform(df, base)
            .withColumn("_new", F.transform("indices", lambda i: F.get(mapping, i)))
            .withColumn("_pairs", F.filter(
                F.arrays_zip(F.col("_new").alias("i"), F.col("weights").alias("w")),
                lambda e: e["i"] >= 0)))
    return (kept.withColumn("features", ar.sparse_vector(chosen.size, F.col("_pairs.i"), F.col("_pairs.w")))
                .drop("_new", "_pairs", "indices", "weights"))


def promote(results: DataFrame, min_delta: float = settings.PROMOTE_DELTA) -> DataFrame:
    """The decision row; raises when the best variant lost the guard term."""
    decision = selection.decide(results, BASELINE, min_delta)
    lost = decision.join(results.where(~F.col("has_guard")), F.col("winner") == F.col("variant"), "left_semi")
    if not lost.isEmpty():
        raise ValueError("the best variant dropped the guard term")
    return decision
