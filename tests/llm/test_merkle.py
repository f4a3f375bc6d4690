"""The Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

from labelloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, tree string, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(top, siblings of every lowest node as a list of (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, range(len(at))):
            i = at[k]
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            p.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
            at[k] = i // 16
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
    return (nodes or [None])[0], paths


def brute(rows):
    by = defaultdict(list)
    for d, s, g, n, t in rows:
        leaf = h(*map(enc, (d, s, g, n, t)))
        bad = d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0
        low = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        by[s].append((d, leaf, h(*map(enc, (d, s, g, n, low))) if bad else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = {s: tree([r[1] for r in by[s]]) for s in order}
    root, over = tree([subs[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, over):
        for (d, leaf, other), path in zip(by[s], subs[s][1]):
            now = other
            for left, right in path + up:
                now = h(left, now, right)
            out[d, leaf, subs[s][0], root, h(*[a + b for a, b in path + up]), now, now == root] += 1
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r[:2], *r[2:5], 7, "x", 1) for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in merkle.digest(merkle.manifest(df)).collect())


def test_trees_of_many_sizes(spark):
    rows = [(k, f"s{s}", "en", 3, f"Text {k}") for s, n in enumerate((1, 2, 15, 16, 17, 33, 257, 300)) for k in range(s * 1000, s * 1000 + n)]
    rows += [(None, None, None, None, None), (5, None, "x", None, ""), (5, None, "x", None, ""), (7, "", "", 0, "É"), (None, "é", "a", -4, "A" * 70000), (10, "~", None, 1, "ABC" * 9)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}


def test_one_source_one_row_and_none(spark):
    for rows in ([(k, "a", "en", k, f"T{k}") for k in range(40)], [(5, None, None, None, "ABC")], [(3, "q", "w", 1, None), (3, "q", "w", 1, None)], []):
        assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    rows = [(k, f"host{k % 290}", "en", 1, f"Row {k}") for k in range(900)]
    assert got(spark, rows) == brute(rows)


def test_a_hot_source_is_numbered_by_many_tasks(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "if(id % 3 = 0, 's', 'hot') as source", "'en' as lang", "id as n_chars", "concat('T', id) as text")
    placed, _ = merkle.placed(merkle.leaves(rows))
    seen = placed.groupBy("tree").agg({"idx": "max", "n": "max", "doc_id": "count"}).collect()
    assert all(r["max(idx)"] + 1 == r["max(n)"] == r["count(doc_id)"] for r in seen)
    assert placed.select("tree", "idx").distinct().count() == 20000


def test_tables_equal_plain_trees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in merkle.digest(merkle.manifest(docs)).collect()) == brute(rows)
