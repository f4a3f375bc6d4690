"""Duplicates, conflicts, splits and folds on small fixtures against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.operators import audit, dedupe, split
from labelloom.plans import preprocess


def random_rows(seed, n=300):
    rng = random.Random(seed)
    # A third of all rows share one text.
    return [("hot" if rng.random() < 0.34 else f"t{rng.randrange(120)}", rng.choice([-1, 0, 1, 1, 1, None, 7]))
            for _ in range(n)]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return random_rows(request.param)


def labels_by_text(rows):
    out = defaultdict(set)
    for t, y in rows:
        out[t].update({y} - {None})
    return out


def test_conflicts(corpus, rows):
    want = {t for t, ys in labels_by_text(rows).items() if len(ys) > 1}
    df = corpus(rows)
    assert {r.text for r in dedupe.conflict_texts(df).collect()} == want
    for hot in (10, 10**6):  # salted and plain paths give the same whole groups
        got = Counter((r.row_id, r.text) for r in dedupe.conflict_rows(df, hot_rows=hot).collect())
        assert got == Counter((i, t) for i, (t, _) in enumerate(rows) if t in want)


def test_exact_repeats(corpus, rows):
    df = corpus(rows)
    size, first = Counter(rows), {}
    for i, r in enumerate(rows):
        first.setdefault(r, i)
    assert {r.row_id for r in dedupe.dedupe_exact(df).collect()} == set(first.values())
    assert {r.row_id for r in dedupe.repeat_rows(df).collect()} == set(range(len(rows))) - set(first.values())
    assert sorted(r.row_id for r in dedupe.dup_group_rows(df).collect()) == [
        i for i, r in enumerate(rows) if size[r] > 1]
    assert len(dedupe.dup_group_rows(df, limit=5).collect()) == 5


def test_resolve_fused_equals_two_steps(corpus, rows):
    df = corpus(rows)
    fused = {(r.row_id, r.label) for r in dedupe.resolve_duplicates(df).collect()}
    steps = {(r.row_id, r.label) for r in dedupe.drop_conflicts(dedupe.dedupe_exact(df)).collect()
             if r.label is not None}
    assert fused == steps


def test_audit_matches_brute_force(corpus, rows):
    row = audit.duplicate_audit(corpus(rows)).first()
    by_text = labels_by_text(rows)
    pairs = set(rows)
    assert row.n_rows == len(rows)
    assert row.exact_repeats == len(rows) - len(pairs)
    assert row.text_repeats == len(rows) - len(by_text)
    assert row.conflict_texts == sum(len(v) > 1 for v in by_text.values())
    assert row.rows_after_exact == len(pairs)
    assert row.rows_after_conflicts == sum(len(by_text[t]) <= 1 for t, _ in pairs)


def test_after_cleaning(corpus):
    out = preprocess.resolve(corpus([
        ("राम्रो", 1), ("राम्रो https://x.y", 1), ("नराम्रो", 1), ("नराम्रो https://x.y", -1),
        ("क", 1), ("क", None), ("ख", 1), ("ख", 5), ("https://only", 0), ("ग", 7)])).collect()
    assert sorted((r.row_id, r.text, r.label) for r in out) == [(0, "राम्रो", 2), (4, "क", 2)]


def test_label_pairs(corpus):
    got = {(r.label_a, r.label_b): r.n
           for r in audit.label_conflict_pairs(corpus([("क", -1), ("क", 0), ("क", 1), ("ख", 0), ("ख", 1)])).collect()}
    assert len(got) == 9 and got[(0, 1)] == got[(1, 0)] == 2 and got[(-1, 1)] == 1 and got[(0, 0)] == 0


def key(i):
    return hashlib.md5(f"42|text {i}".encode()).hexdigest(), i



def split_rows(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"text {i}", label))
            i += 1
    return spark.createDataFrame(rows, "row_id bigint, text string, label int").repartition(5)


@pytest.mark.parametrize("sizes", [{0: 201, 1: 50, 2: 333}, {0: 1, 1: 2, 2: 3}, {0: 500}, {0: 1, 2: 997}])
def test_split_is_exact(spark, sizes):
    df = split_rows(spark, sizes)
    got = split.stratified_split(df).collect()
    n = sum(sizes.values())
    want_total = math.ceil(0.2 * n)
    ideal = {y: c * want_total / n for y, c in sizes.items()}
    quota = {y: math.floor(v) for y, v in ideal.items()}
    for y in sorted(ideal, key=lambda y: (-(ideal[y] - quota[y]), y))[: want_total - sum(quota.values())]:
        quota[y] += 1
    assert len(got) == n
    for y in sizes:
        ids = sorted((r.row_id for r in got if r.label == y), key=key)
        test = {r.row_id for r in got if r.label == y and r.split == "test"}
        assert test == set(ids[: quota[y]])


@pytest.mark.parametrize("sizes", [{0: 201, 1: 50, 2: 333}, {0: 1, 1: 2, 2: 3}])
def test_folds_are_exact(spark, sizes):
    got = split.stratified_folds(split_rows(spark, sizes)).collect()
    for y, n in sizes.items():
        ids = sorted((r.row_id for r in got if r.label == y), key=key)
        fold = {r.row_id: r.fold for r in got}
        assert [fold[i] for i in ids] == [r * 5 // n for r in range(n)]


def test_split_does_not_depend_on_files(spark):
    texts = [f"text {i}" for i in range(200)]
    def parts(order):
        df = spark.createDataFrame([(n, texts[i], i % 3) for n, i in enumerate(order)], "row_id bigint, text string, label int")
        return {r.text: r.split for r in split.stratified_split(df).collect()}
    assert parts(range(200)) == parts(reversed(range(200)))


def test_rows_without_label_are_kept(spark):
    df = spark.createDataFrame([(i, f"text {i}", None if i % 5 == 0 else 1) for i in range(40)], "row_id bigint, text string, label int")
    got = Counter((r.label, r.split) for r in split.stratified_split(df).collect())
    assert got == Counter({(None, "test"): 2, (None, "train"): 6, (1, "test"): 6, (1, "train"): 26})
    assert len(split.stratified_folds(df).collect()) == 40


def test_split_does_not_leak(corpus):
    rows = [(f"text {i % 70}", 0) for i in range(200)]
    out = preprocess.prepare(corpus(rows))
    leak = split.split_leakage(out).first()
    assert leak.shared_texts == 0 and leak.train_texts + leak.test_texts == 70
    assert {r.split: r.n for r in split.split_balance(out).collect()} == {"test": 14, "train": 56}


def test_samples_per_class(corpus, rows):
    got = dedupe.samples_per_class(corpus(rows), 3).collect()
    for y in {y for _, y in rows} - {None}:
        assert sorted(r.row_id for r in got if r.label == y) == [i for i, (_, l) in enumerate(rows) if l == y][:3]


def test_length_tables(spark, corpus):
    import numpy as np
    rng = random.Random(3)
    texts = ["x" * rng.randrange(1, 400) for _ in range(500)]
    counts = audit.length_counts(corpus([(t, 0) for t in texts])).cache()
    lens = np.array([len(t) for t in texts])
    s = audit.length_summary(counts).where("unit = 'chars'").first()
    assert s.n_rows == 500 and s.max == lens.max()
    for name, p in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert abs(s[name] - np.percentile(lens, p)) < 1e-6
    assert abs(s["std"] - lens.std(ddof=1)) < 1e-5
    cap = int(np.percentile(lens, 99))
    want, _ = np.histogram(np.minimum(lens, cap), bins=50)
    got = audit.length_histogram(counts).where("unit = 'chars'").orderBy("bin").collect()
    assert [r.n for r in got] == want.tolist()
    same = audit.length_histogram(audit.length_counts(corpus([("aa", 0)] * 4))).where("unit = 'chars'")
    assert same.agg(F.sum("n")).first()[0] == 4
    rec = {r.unit: r for r in audit.recommend_max_length(counts).collect()}
    assert rec["words"].suggested == 32 and rec["words"].advice == "shrink" and rec["words"].saving_pct == 50.0
