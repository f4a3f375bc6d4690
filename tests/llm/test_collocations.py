"""Collocations against plain Python counts, and their exact arithmetic."""

import random
import re
from collections import Counter, defaultdict

from labelloom.llm import collocations

SCHEMA = "text string, lang string, block int, phrase string, n int, codes string"


def brute(rows, least, most=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b == a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            s, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(spark, rows, least, **more):
    df = spark.createDataFrame([(t, g, 1, "x", 2, "y") for t, g in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, least, **more).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "New", "york", "City", "of", "é", "x.", "a,b", "q\t", "r!", "\n", "Ünï", "z" * 3000]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for _ in range(n)]


def test_small_corpora(spark):
    odd = [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("a a a a a a a a a", "xx"), ("b" * 100000 + " c", "yy"), ("one two three four five six " * 30, "zz"), ("one two three four five six. " * 30, "z2")]
    rows = corpus(1, 120) + odd * 2
    assert got(spark, rows, 4) == brute(rows, 4)
    assert got(spark, rows, 6, max_words=3, top=7) == brute(rows, 6, 3, 7)


def test_nothing_frequent_and_no_rows(spark):
    assert got(spark, [("a b c", "en"), (None, None)], 5) == got(spark, [], 5) == []


def test_a_phrase_across_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    rows = corpus(2, 150)
    assert got(spark, rows, 5) == brute(rows, 5)


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randint(10 ** 14, 10 ** 16 - 1) for _ in range(4)) for _ in range(500)] + [(10 ** 16 - 1,) * 4, (100, 100, 100, 10 ** 16 - 1)]
    rows = [(min(a, l, r), l, r, n) for a, l, r, n in rows]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint, n bigint")
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in df.withColumn("s", collocations.score("a", "l", "r", "n")).collect())


def test_tables_equal_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == brute(rows, 100)
    assert not spark.catalog.listTables()


def test_only_hashes_of_rare_phrases_are_sent(spark, monkeypatch):
    """Phrase strings are grouped only where their hash is frequent; colliding rare phrases are told apart by their strings."""
    rows = [(f"rare{k} one two", "en") for k in range(300)]
    want = brute(rows, 50)
    sent, before = [], collocations.buckets.small
    monkeypatch.setattr(collocations.buckets, "small", lambda df: sent.append(df.count()) or before(df))
    assert got(spark, rows, 50) == want
    assert sent and max(sent) <= 4
    monkeypatch.setattr(collocations.F, "hash", lambda *c: collocations.F.lit(7))
    assert got(spark, rows, 50) == want
