"""TF-IDF, feature selection and ablation against plain Python."""

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import chars
from labelloom.operators import selection, tfidf
from labelloom.plans import ablation

FIVE = ["त्यो नाटक रमाइलो छ", "यो फिल्म राम्रो छैन", "खाना मिठो छ", "सेवा नराम्रो थियो सेवा", "मलाई मन पर्‍यो"]


def terms_of(text):
    toks = text.lower().split()
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def brute(train, docs, k=10000, min_df=1, max_df=1.0):
    ctf, df = Counter(), Counter()
    for d in train:
        ctf.update(terms_of(d))
        df.update(set(terms_of(d)))
    n = len(train)
    ok = [t for t in ctf if min_df <= df[t] <= max_df * n]
    vocab = sorted(sorted(ok, key=lambda t: (-ctf[t], t))[:k])
    out = []
    for d in docs:
        w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1)
             for t, c in Counter(terms_of(d)).items() if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({vocab.index(t): v / norm for t, v in w.items()})
    return vocab, out


@pytest.fixture(scope="module")
def random_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)]


@pytest.mark.parametrize("k,min_df,max_df", [(10000, 1, 1.0), (40, 1, 1.0), (60, 3, 0.5)])
def test_weights(corpus, random_docs, monkeypatch, k, min_df, max_df):
    docs = random_docs + ["unknown words only"]
    df = corpus([(d, 0) for d in docs])
    train = df.where(F.col("row_id") < len(random_docs))
    model = tfidf.fit(train, k, min_df, max_df)
    vocab, want = brute(random_docs, docs, k, min_df, max_df)
    assert [r.term for r in model.vocab.orderBy("idx").collect()] == vocab

    def check(rows):
        assert len(rows) == len(docs)
        for r in rows:
            got = dict(zip(r.indices, r.weights))
            assert got.keys() == want[r.row_id].keys()
            assert all(abs(got[i] - v) < 1e-12 for i, v in want[r.row_id].items())

    check(tfidf.transform(df, model).collect())
    joined = Counter(r.row_id for r in tfidf.weights_by_join(df, model).collect())
    assert joined == Counter({i: len(w) for i, w in enumerate(want) if w})
    monkeypatch.setattr(settings, "MAX_BROADCAST_BYTES", 0)
    # A vocabulary too large to ship is joined, with the same values.
    check(tfidf.transform(df, model).collect())
    assert joined == Counter(r.row_id for r in tfidf.weights_by_join(df, model).collect())


def test_most_frequent_prefilter(spark):
    rng = random.Random(9)
    stats = [(f"t{i}", rng.choice([1, 1, 1, 2, 3, 50, 1000])) for i in range(300)]
    df = spark.createDataFrame(stats, "term string, ctf bigint")
    for k in (1, 40, 150, 300, 400):
        want = sorted(stats, key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(map(tuple, tfidf.most_frequent(df, k).collect())) == sorted(want)


def test_vectors_and_density(corpus):
    df = corpus([(t, 0) for t in FIVE])
    model = tfidf.fit(df)
    rows = tfidf.with_vectors(df, model).collect()
    assert all(abs(r.features.norm(2) - 1) < 1e-12 and r.features.size == model.size for r in rows)
    d = tfidf.density(df, model).first()
    assert d.nnz == sum(r.features.numNonzeros() for r in rows) and d.n_rows == 5
    assert tfidf.vocab_sample(model.vocab, 3).count() == 3


def test_transform_has_no_shuffle(corpus):
    df = corpus([(t, 0) for t in FIVE])
    plan = tfidf.with_vectors(df, tfidf.fit(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_counting_moves_no_text(corpus):
    plan = tfidf.term_stats(corpus([(t, 0) for t in FIVE]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(term" in plan


def test_terms_are_dealt_by_the_bytes_of_text(spark, monkeypatch):
    texts = ["aa bb aa", "bb cc", None, "", "aa  bb cc", "dd " * 40]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "row_id bigint, text string")
    plain = sorted(map(tuple, tfidf.term_stats(df).collect()))
    model = tfidf.fit(df)
    weights = sorted(map(tuple, tfidf.weights_by_join(df, model).collect()))
    monkeypatch.setattr(tfidf, "SLICE_TOKENS", 3)
    monkeypatch.setattr(tfidf, "PARTITION_BYTES", 10)  # 142 bytes of text
    assert tfidf.term_stats(df).rdd.getNumPartitions() == tfidf.term_counts(df).rdd.getNumPartitions() == 15
    assert sorted(map(tuple, tfidf.term_stats(df).collect())) == plain
    assert sorted(map(tuple, tfidf.weights_by_join(df, model).collect())) == weights


def test_a_token_with_spaces_counts_with_the_ngram_it_equals(spark):
    how = tfidf.Vectorizer((1, 2), r"[a-z]+(?: x)?")
    df = spark.createDataFrame([(1, "a x, a, x"), (2, "x. a")], "row_id bigint, text string")
    assert sorted(map(tuple, tfidf.term_stats(df, how).collect())) == [
        ("a", 2, 2), ("a x", 2, 1), ("a x a", 1, 1), ("x", 2, 2), ("x a", 1, 1)]
    assert {(r.row_id, r.term, r.tf) for r in tfidf.term_counts(df, how=how).collect() if r.term == "a x"} == {(1, "a x", 2)}


@pytest.mark.parametrize("how", [tfidf.Vectorizer((1, 1)), tfidf.Vectorizer((1, 3), sublinear_tf=False),
                                 tfidf.Vectorizer((2, 2), chars.TOKEN_WITHOUT_DANDA)])
def test_options(corpus, how):
    docs = ["क ख क। ख", "क ख ग", "ग ग ग ख"]
    lo, hi = how.ngram_range
    pattern = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), how.token_pattern))

    def terms(d):
        t = pattern.findall(d.lower())
        return [" ".join(t[i:i + n]) for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]
    model = tfidf.fit(corpus([(d, 0) for d in docs]), how=how)
    df = Counter(t for d in docs for t in set(terms(d)))
    vocab = sorted(df)
    assert [r.term for r in model.vocab.orderBy("idx").collect()] == vocab
    for r in tfidf.transform(corpus([(d, 0) for d in docs]), model).collect():
        w = {vocab.index(t): ((1 + math.log(c)) if how.sublinear_tf else c) * (math.log(4 / (1 + df[t])) + 1)
             for t, c in Counter(terms(docs[r.row_id])).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        assert r.indices == sorted(w) and all(abs(x - w[i] / norm) < 1e-12 for i, x in zip(r.indices, r.weights))


def test_save_and_load(spark, corpus, tmp_path):
    df = corpus([(t, 0) for t in FIVE])
    model = tfidf.fit(df, how=tfidf.Vectorizer((1, 3), sublinear_tf=False))
    model.save(f"{tmp_path}/v")
    again = tfidf.Tfidf.load(spark, f"{tmp_path}/v")
    take = lambda m: sorted((r.row_id, r.indices, r.weights) for r in tfidf.transform(df, m).collect())
    assert take(model) == take(again) and again.how == model.how
    with pytest.raises(AnalysisException):
        tfidf.Tfidf.load(spark, f"{tmp_path}/none")


def test_empty_vocabulary(corpus):
    df = corpus([("a b", 0), ("c", 1)])
    model = tfidf.fit(df, min_df=2)
    assert model.size == 0
    assert [r.indices for r in tfidf.transform(df, model).collect()] == [[], []]


def test_chi2(corpus, random_docs):
    rng = random.Random(1)
    labels = [rng.choice([0, 1, 1, 2]) for _ in random_docs]
    df = corpus(list(zip(random_docs, labels)))
    model = tfidf.fit(df)
    vocab, weights = brute(random_docs, random_docs)
    got = {r.idx: r.score for r in selection.chi2_scores(df, model).collect()}
    n = len(labels)
    for j in range(len(vocab)):
        total = sum(w.get(j, 0) for w in weights)
        score = 0
        for c in range(3):
            e = labels.count(c) / n * total
            o = sum(w.get(j, 0) for w, y in zip(weights, labels) if y == c)
            score += (o - e) ** 2 / e
        assert abs(got[j] - score) < 2e-6


def test_ablation(corpus):
    train = corpus([(t, y) for t, y in zip(FIVE, (2, 0, 2, 0, 1))] * 2)
    models = ablation.fit_variants(train, top_k=6, min_df=3)
    assert list(models) == ablation.VARIANTS and models["chi2"].size == 6
    table = ablation.run(train, train, models, guard="छैन")
    rows = {r.variant: r for r in table.collect()}
    assert rows["baseline"].has_guard and rows["baseline"].accuracy == 1.0
    assert rows["chi2"].vocab_size == 6
    kept = {(r.variant, r.term): r.kept
            for r in selection.guard_terms(ablation.variant_terms(models), ["छ", "nope"]).collect()}
    assert kept["baseline", "छ"] and not kept["baseline", "nope"]


def test_promotion(spark):
    def table(*rows):
        return spark.createDataFrame(
            [(v, i, f, g) for i, (v, f, g) in enumerate(rows)],
            "variant string, position int, macro_f1 double, has_guard boolean")
    up = ablation.promote(table(("baseline", 0.6, True), ("chi2", 0.62, True))).first()
    assert (up.winner, up.decision) == ("chi2", "promote")
    small = ablation.promote(table(("baseline", 0.6, True), ("chi2", 0.6005, True))).first()
    assert small.decision == "keep"
    tie = ablation.promote(table(("baseline", 0.6, True), ("chi2", 0.6, True))).first()
    assert tie.winner == "baseline"
    with pytest.raises(ValueError):
        ablation.promote(table(("baseline", 0.6, True), ("chi2", 0.7, False)))
