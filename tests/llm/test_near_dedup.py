"""The pipeline's near-dedup against brute-force Jaccard."""

import random

from labelloom.llm import simhash


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def jaccard_groups(rows):
    """{doc_id: smallest doc_id of its group} over all pairs with a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t or "") for _, t in rows]
    up = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    return {rows[k][0]: min(rows[j][0] for j, v in enumerate(up) if v == u) for k, u in enumerate(up)}


def test_a_group_above_the_small_bucket(docs):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(45):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(rows)).collect()}
    assert got == jaccard_groups(rows)


def test_near_dedup_equals_brute_force_jaccard(docs):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(rows)).collect()}
    assert got == dict(enumerate(up)) and 12 <= len(set(up)) < len(rows)
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == set(up)


def test_candidates_come_from_simhash_fingerprints(spark, docs, monkeypatch):
    text = " ".join(f"w{k}" for k in range(40))
    row = simhash.wide_fingerprints(spark.createDataFrame([(1, text)], "id bigint, text string"), 5).first()
    held = {int(h) for h in simhash.shingle_hashes(text.encode(), 5)}
    assert row.n_chars == len(held) == 36
    assert row.f1 % 2 ** 64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in held) > len(held))
    rows = [(1, text), (2, text + " x"), (3, "y " + text), (4, " ".join(f"v{k}" for k in range(40)))]
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs(rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    monkeypatch.setattr(simhash, "bits_apart", lambda similarity: -1)
    assert {r.component_id for r in simhash.similar_texts(docs(rows)).collect()} == {1, 2, 3, 4}


def test_candidates_without_a_common_block_are_found(docs, monkeypatch):
    rng = random.Random(12)
    rows = []
    for _ in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(9, 60))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:len(w) - (len(w) - 4) // 5]))]
    monkeypatch.setattr(simhash.lines, "meet", lambda lines, *_: lines.sparkSession.createDataFrame([], "a bigint, b bigint, bucket bigint"))
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs(rows)).collect()}
    assert got == jaccard_groups(rows) == {k: k - k % 2 for k in range(60)}


def test_texts_without_words_and_repeated_ids(docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, ""), (2, "  "), (3, None), (4, "\n"), (5, text), (7, "other words stand here and stay"), (7, text + " x"), (None, text), (None, "a row without an id that is alone"), (9, text), (5, "y " + text)]
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in simhash.keep_one(docs(rows)).collect())
    one = [(d, n) for d, n in kept if d == 5]
    assert len(one) == 1 and [k for k in kept if k[0] != 5] == [(0, 33), (1, 0), (7, 31)]
