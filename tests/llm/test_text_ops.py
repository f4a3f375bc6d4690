"""SimHash, decontamination, quality and piece operators against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from labelloom.llm import decontaminate, pieces, quality, queries, simhash

LONG = " ".join(f"w{i % 977}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, LONG), (7, LONG + " end"), (7, "é ß x y z"), (None, "one two"), (9, "a b c d e f")]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows):
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return Counter((d, f"{f:016x}", low.get(top(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_simhash_rows(docs):
    got = rows_of(simhash.near_duplicates(docs(ODD)), "doc_id", "fingerprint", "component_id")
    assert got == simhash_groups(ODD)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_simhash_query(spark, sf, corpus_rows):
    assert rows_of(queries.op2_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == simhash_groups(corpus_rows)


def test_ball_links_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}) for c in centres for _ in range(20)} | {0, (1 << 64) - 1}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()

    def classes(pairs):
        up = {f[0]: f[0] for f in signed}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in pairs:
            up[top(a)] = top(b)
        out = {}
        for i in up:
            out.setdefault(top(i), set()).add(i)
        return {frozenset(s) for s in out.values()}
    near = [(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert classes((r.a, r.b) for r in links) == classes(near)


def keeper(rows):
    return sorted(d for d, _ in rows if d is not None)


def test_keep_one_keeps_one_of_each_group(docs):
    kept = simhash.keep_one(docs([(3, "a b c d e f g"), (2, "A b c d  e f g"), (8, "q r s t u"), (None, "x y z")]))
    assert rows_of(kept, "doc_id") == Counter([(2,), (8,), (None,)])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def contamination(rows, items, width=10):
    wins = {}
    for i, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[s:s + width]), set()).add(i)
    out = Counter()
    for d, t in rows:
        w, hit, names = words_of(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    names |= wins[k]
        names = ",".join(sorted({str(n) for n in names if n is not None}))
        out[d, len(w), len(hit), len(names.split(",")) if names else 0, hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


DECON = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_rows(spark, docs):
    rows = ODD + [(20, "x " + " ".join(f"W{i}" for i in range(3, 15)) + ", one!"), (21, "A-b c"), (22, "日本 a b")]
    items = [(1, LONG[:400]), (10, "one"), (2, "a b"), (3, None), (4, ""), (None, "b c"), (2, "a b"), (5, "日本"), (6, "!!")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(decontaminate.contamination(docs(rows), table), *DECON) == contamination(rows, items)
    assert decontaminate.contamination(docs([]), table).count() == 0
    assert rows_of(decontaminate.contamination(docs(rows), table.limit(0)), *DECON) == contamination(rows, [])
    assert rows_of(decontaminate.keep_clean(docs(rows), table), "doc_id") == Counter((d,) for d, *_, bad in contamination(rows, items).elements() if not bad and d not in (7,))


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (100,))
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(5)]
    rows = [(1, LONG), (2, "w0 w1 w2"), (3, " ".join(f"w{j}" for j in range(3, 16)))]
    assert rows_of(decontaminate.contamination(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")), *DECON) == contamination(rows, items)


def test_decontamination_query(spark, sf, corpus_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(queries.op3_decontamination(spark, sf), *DECON)
    assert got == contamination(corpus_rows, items)
    assert sum(n for k, n in got.items() if k[-1]) > 5


def test_proximity(spark, docs):
    index = decontaminate.build_index(docs([(1, "red fish x x blue"), (2, "red " + "x " * 20 + "blue fish"), (3, "blue red fish"), (4, None)]))
    items = spark.createDataFrame([(7, "red blue fish"), (8, "absent red")], "item_id bigint, text string")
    assert rows_of(decontaminate.proximity(index, items, 4), "doc_id", "item_id") == Counter([(1, "7"), (3, "7")])


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rows(spark, docs):
    rows = ODD + [(30, "a b\n\n a b\na b \na b\n|x|é<\na b"), (31, "x y z u v " * 9)]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.verdicts(docs(rows), none)
    assert rows_of(got, *BASE) == Counter((d, *base(t)) for d, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got.collect())
    assert quality.verdicts(docs([]), none).count() == 0


def test_quality_query(spark, sf, corpus_rows):
    got = queries.op4_quality(spark, sf).collect()
    assert Counter(tuple(r[c] for c in BASE) for r in got) == Counter((d, *base(t)) for d, t in corpus_rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    assert np.mean([k for k, q in judged if q]) > 0.97


def test_quality_on_held_out_rows(spark, sf):
    stats = quality.statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(stats, labels.where("doc_id % 4 > 0"))
    test = stats.join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    p = model.score(quality.features({c: test[c].to_numpy() for c in quality.COUNTS}))
    assert ((p > 0.5) == test.quality).mean() > 0.93


def test_trees_obey_the_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + np.sin(9 * x[:, 0]) / 3 - x[:, 1] + rng.normal(0, .3, 800)) > 0).astype(float)
    model = quality.fit(x, y, np.array([1, -1, 0]))
    assert ((model.score(x) > .5) == y).mean() > 0.8
    for j, s in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((40, 3)), 50, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        assert (s * np.diff(model.score(grid).reshape(40, 50)) >= -1e-12).all()


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def digests(library, rows):
    out = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        out[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    return out


PIECES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_pieces_rows(docs, library):
    rows = ODD + [(40, "▁a  ▁▁ b"), (41, "\x00\r\n😀日本語の 한국"), (42, "a" * 3000), (43, " lead and trail ")]
    assert rows_of(pieces.encoded(docs(rows), queries.piece_model()), *PIECES) == digests(library, rows)
    assert pieces.encoded(docs([]), queries.piece_model()).count() == 0


def test_pieces_query(spark, sf, corpus_rows, library):
    assert rows_of(queries.op6_pieces(spark, sf), *PIECES) == digests(library, corpus_rows)


def test_pieces_like_the_library(library):
    rng = random.Random(3)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(40))) for a in ("ab", "a ", "aA", "=-", "tion", "1 1", "the ", " ▁x") for _ in range(300)]
    enc = pieces.Encoder(queries.piece_model())
    ids, off = enc.encode(texts)
    for t, a, b in zip(texts, off, off[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_eos=True)
        assert enc.model.decode(ids[a:b].tolist()) == library.decode(ids[a:b].tolist())
