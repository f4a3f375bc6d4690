"""Exact dedup against groups of normalised texts in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from labelloom.llm import exact

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        stays = True
        for d in ids:
            out[d, keep, len(ids), d == keep and stays, hashlib.sha256(t.encode()).hexdigest()] += 1
            stays = stays and d != keep
    return out


def got(df, **limits):
    return Counter(tuple(r[c] for c in COLUMNS) for r in exact.copies(df, **limits).collect())


ODD = [(1, None), (2, ""), (3, " "), (4, "\n\t "), (5, "a b"), (6, "a\tb"), (6, "a\tb"), (None, "a  b"), (None, "only"), (None, "only"), (7, "a b "), (8, " a b"),
       (9, "É x"), (10, "É x"), (-5, "x" * 200000), (11, "x" * 200000), (12, "x" * 199999 + "y"), (13, "\x00"), (14, "\x1f"), (9223372036854775807, "É x")]


def test_odd_rows(docs):
    assert got(docs(ODD)) == brute(ODD)
    assert got(docs([])) == Counter()
    assert Counter((r.doc_id, r.text) for r in exact.drop_copies(docs(ODD)).collect()) == Counter(
        {(d, t): 1 for d, t in [(1, None), (3, " "), (5, "a b"), (None, "only"), (7, "a b "), (8, " a b"), (9, "É x"), (10, "É x"), (-5, "x" * 200000), (12, "x" * 199999 + "y"), (13, "\x00"), (14, "\x1f")]})


def test_spills_and_salts_change_nothing(spark, docs):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 9))) + rng.choice(["", "tail" * 50, "tale" * 50])) for k in range(3000)] + [(9000 + k, "hot text") for k in range(1500)]
    want = brute(rows)
    assert got(docs(rows)) == want
    assert got(docs(rows), trie_bytes=300, fold_bytes=2000) == want
    assert got(docs(rows), hot_bytes=3000, fold_bytes=500, trie_bytes=5000) == want


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=40), st.integers(20, 200))
@settings(max_examples=200, deadline=None)
def test_trie_owns_and_spills(texts, limit):
    trie, out = exact.Trie(), []
    for k, t in enumerate(texts):
        if not trie.insert(t, k, 1, 0, True):
            out.append((t, k, 1))
        while trie.n_bytes > limit and (gone := trie.spill()):
            out += [tuple(o[:3]) for o in gone]
    held = [tuple(o[:3]) for o in trie.owners()]
    assert len(held) == trie.n_owners == len({t for t, *_ in held}) and (held or not texts)
    assert trie.n_bytes == sum(len(t) for t, *_ in held) and (trie.n_bytes <= limit or len(held) == 1)
    assert not {t for t, *_ in held} & {t for t, *_ in out}  # a text is settled or goes on, never both
    rows = defaultdict(int)
    for t, _, n in held + out:
        rows[t] += n
    assert rows == Counter(texts)


def test_hot_rows_are_sent_once_per_task(spark):
    rows = spark.range(30000, numPartitions=4).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    sent = exact._entries(rows, exact.np.array([exact.content_hash(b"the same text")]), 64, 3, exact.FOLD_BYTES)
    one = sent.where("not last").collect()
    assert len(one) <= 4 and sum(r.n for r in one) == 10000 and len({r.bucket for r in one}) > 1


def test_tables_equal_plain_groups(spark, sf, corpus_rows):
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == brute(corpus_rows)
