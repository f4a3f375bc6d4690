"""The summary's vocabulary equals the plain one: ties, limits, overlapping bounds, odd texts."""

import random
from collections import Counter

import pytest

from labelloom.operators import heavy, tfidf

UNI = tfidf.Vectorizer((1, 1))


def texts(n, words, seed=5):
    rng = random.Random(seed)
    return [(" ".join(f"w{int(words * rng.random() ** 4):05d}" for _ in range(rng.randint(0, 40))), i % 3) for i in range(n)]


def listed(model):
    return sorted((r.term, r.idx, r.ctf, r.df, round(r.idf, 9)) for r in model.vocab.collect())


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus(texts(3000, 20000) + [(None, 0), ("", 1), ("  ", 2)]).repartition(6)


@pytest.fixture
def small_sketches(monkeypatch):
    for name, value in {"LISTED_PER_TERM": 6, "MIN_LISTED": 150, "KEPT_PER_LISTED": 12}.items():
        monkeypatch.setattr(heavy, name, value)


def test_bounds_hold_for_every_term(rows, small_sketches):
    true = Counter(w for r in rows.collect() for w in (r.text or "").split())
    found = heavy.bounds(rows, 50, UNI)
    low = {r.term: r.low for r in found.lows.collect()}
    assert found.error > 6 and len(low) <= 6 * 6 * 50 < len(true)
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + found.error for t, n in true.items())


@pytest.mark.parametrize("k", [1, 20, 50])
def test_equals_plain_fit(rows, small_sketches, k):
    stats = heavy.top_stats(rows, k, how=UNI)
    assert stats is not None and stats.count() < 1000
    assert listed(heavy.fit(rows, k, how=UNI)) == listed(tfidf.fit(rows, k, how=UNI))


def test_ties_at_the_cut_go_to_the_lower_term(corpus):
    many = " ".join(f"t{i:02d}" for i in range(30))
    df = corpus([(many, 0)] * 40 + [(f"t29 rare{i}", 1) for i in range(200)]).repartition(4)
    assert heavy.top_stats(df, 10, how=UNI).count() >= 30
    assert [r[0] for r in listed(heavy.fit(df, 10, how=UNI))] == [f"t{i:02d}" for i in range(9)] + ["t29"]


def test_overlapping_bounds_fall_back_to_plain_counts(corpus, rows, small_sketches):
    flat = corpus([(f"a{i} b{i} c{i}", 0) for i in range(2000)]).repartition(4)  # every term once
    assert heavy.top_stats(flat, 7, how=UNI) is None
    assert listed(heavy.fit(flat, 7, how=UNI)) == listed(tfidf.fit(flat, 7, how=UNI))
    assert heavy.top_stats(corpus([("one two", 0)]), 5, how=UNI) is None
    assert len(listed(heavy.fit(corpus([("one two", 0)]), 5, how=UNI))) == 2


def test_document_limits(rows, small_sketches):
    for limits in ({"max_df": 0.05}, {"min_df": 40}, {"min_df": 30, "max_df": 0.2}, {"max_df": 0.001}):
        assert listed(heavy.fit(rows, 20, how=UNI, **limits)) == listed(tfidf.fit(rows, 20, how=UNI, **limits)), limits
    assert heavy.top_stats(rows, 20, max_df=0.05, how=UNI) is not None


def test_large_candidate_sets_fall_back(rows, small_sketches, monkeypatch):
    monkeypatch.setattr(heavy.settings, "MAX_BROADCAST_BYTES", 20)
    assert heavy.top_stats(rows, 20, how=UNI) is None


def test_no_terms(corpus):
    for df in (corpus([(None, 0), ("", 1)]), corpus([("x y", 0)]).where("row_id < 0")):
        assert heavy.fit(df, 5).size == 0
