"""Window, byte and line dedup, sharding, chat and page operators against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from labelloom.llm import arrays, chat, lines, pages, queries, shuffle, substrings, suffixes

LONG = " ".join(f"w{i % 977}é" for i in range(20000))
SHARED = " ".join(f"s{i}" for i in range(45))


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def sha(x):
    return hashlib.sha256(x).hexdigest()


WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def windows(rows, width=20):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [(t or "").encode().split() for _, t in docs]
    seen, out = set(), Counter()
    for (d, _), w in zip(docs, words):
        gone = set()
        for s in range(len(w) - width + 1):
            k = b" ".join(w[s:s + width])
            if k in seen:
                gone |= set(range(s, s + width))
            seen.add(k)
        out[d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


PASSAGES = [(5, None), (6, ""), (7, " \n"), (1, "x " + SHARED), (2, SHARED + " y"), (3, "z " + SHARED[20:] + " tail"), (4, "one two"), (8, "r " * 70), (9, LONG), (-4, "q " + SHARED + " q"), (None, "n " + SHARED)]


def test_windows_rows(docs):
    assert rows_of(substrings.dedup_windows(docs(PASSAGES)), *WORDS) == windows(PASSAGES)
    assert substrings.dedup_windows(docs([])).count() == 0


def test_windows_intervals_and_repeated_rows(docs):
    got = substrings.dedup_windows(docs([(1, SHARED), (2, "a " + SHARED + " b c"), (2, "a " + SHARED + " b c")]), with_text=True).collect()
    assert sorted((r.doc_id, r.starts, r.ends, r.kept) for r in got) == [(1, [], [], SHARED), (2, [1], [46], "a b c"), (2, [1], [46], "a b c")]


def test_windows_query(spark, sf, corpus_rows):
    got = rows_of(queries.op5_substrings(spark, sf), *WORDS)
    assert got == windows(corpus_rows)
    assert sum(k[2] > 0 for k in got) > 50


def test_windows_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 900)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + " " + SHARED[rng.randrange(90):]) for i in range(150)]
    assert rows_of(substrings.dedup_windows(docs(rows)), *WORDS) == windows(rows)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strings(rows, length=200):
    at = defaultdict(list)
    raw = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            at[b[s:s + length]].append((k, s))
    gone = [bytearray(len(b)) for b in raw]
    for where in at.values():
        if len(where) > 1:
            for k, s in where:
                gone[k][s:s + length] = b"\1" * length
    return Counter((d, len(b), sum(g), len(re.findall(b"\1+", bytes(g))), sha(bytes(x for x, y in zip(b, g) if not y))) for (d, _), b, g in zip(rows, raw, gone))


def passage_rows(n, seed):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefgh é") for _ in range(260)) for _ in range(4)]
    other = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(k)))
    rows = []
    for i in range(n):
        c = rng.choice(common)
        if rng.random() < .3:  # the same ends around another middle
            c = c[:120] + rng.choice("XYZ") + c[121:]
        rows.append((i, other(120) + c[rng.randrange(40):260 - rng.randrange(30)] + other(300)))
    return rows


def test_bytes_rows(docs):
    rows = PASSAGES[:-2] + [(20, "a" * 500), (21, "b" * 199), (22, "b" * 199), (23, "c" * 200), (24, "c" * 200), (24, "c" * 200), (None, "d" * 201)] + [(100 + i, t) for i, t in passage_rows(60, 2)]
    rows = [r for r in rows if r[1] != LONG]
    assert rows_of(suffixes.dedup_bytes(docs(rows)), *BYTES) == strings(rows)
    assert suffixes.dedup_bytes(docs([])).count() == 0


def test_bytes_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1500)
    rows = passage_rows(160, 7)
    got = suffixes.dedup_bytes(docs(rows), with_text=True)
    assert rows_of(got, *BYTES) == strings(rows)


def test_bytes_in_parts_of_a_bucket(docs, monkeypatch):
    for name, n in (("BLOCK_BYTES", 1500), ("KEY_BYTES", 700), ("SORT_ROWS", 60)):
        monkeypatch.setattr(suffixes, name, n)
    rows = passage_rows(120, 8) + [(500 + k, "ab" * 300) for k in range(4)]
    assert rows_of(suffixes.dedup_bytes(docs(rows)), *BYTES) == strings(rows)


def test_no_bucket_holds_a_share_of_a_language():
    rng = random.Random(5)
    often = ["the", "of", "and", "thing", "ation", "er", "on"]
    text = " ".join("".join(rng.choices(often, k=rng.randrange(1, 4))) for _ in range(150_000)).encode()
    buf = np.frombuffer(text, np.uint8)
    sums = arrays.BYTES.sums(arrays.BYTES.symbols[buf])
    held = np.bincount(suffixes.suffix_buckets(sums, np.arange(len(buf) - 199), 200, 1000), minlength=1000)
    assert held.max() < 8 * held.mean()


def test_bytes_query(spark, sf, corpus_rows):
    got = rows_of(queries.op9_suffixes(spark, sf), *BYTES)
    assert got == strings(corpus_rows)
    assert sum(k[2] > 0 for k in got) > 50


def test_cover_is_a_difference_cover():
    d = {(int(a) - int(b)) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert d == set(range(suffixes.PERIOD)) and len(suffixes.COVER) ** 2 - len(suffixes.COVER) == suffixes.PERIOD - 1


def edit(a, b):
    """Edit distance, a column of the table at a time as the bits of one number."""
    if not a or not b:
        return max(len(a), len(b))
    at, full, top = {}, (1 << len(a)) - 1, 1 << len(a) - 1
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    up, down, out = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        out += bool(plus & top) - bool(minus & top)
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~((eq | down) | plus)) & full, plus & (eq | down) & full
    return out


def plain_fingerprints(line):
    """Both fingerprints of a normalised line, bit by bit."""
    line = line.ljust(3)
    runs = [sum(ord(c) * int(f) for c, f in zip(x, lines.RUN_FACTORS)) & (1 << 64) - 1 for x in zip(line, line[1:], line[2:])]
    out = []
    runs = arrays.mix(np.array(sorted(set(runs)), np.uint64))
    for hashes in (runs, arrays.mix(runs ^ lines.SECOND)):
        ones = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        out.append(sum((2 * n > len(hashes)) << b for b, n in enumerate(ones)))
    return out


def met(a, b):
    """Whether the pigeonhole search looks at two lines, given as (fingerprints, length)."""
    (f, n), (g, m) = a, b
    if sum((x ^ y).bit_count() for x, y in zip(f, g)) > lines.DISTANCE:
        return False
    for x, y in zip(f, g):
        same = [i for i in range(8) if (x ^ y) >> 8 * i & 255 == 0]
        if any(math.floor(math.log2(n) + i / 7) == math.floor(math.log2(m) + i / 7) for i in same[:-1]):
            return True
    return False


def line_groups(spark, rows):
    """Kept texts by the definition: every pair of distinct normalised lines is looked at."""
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id bigint, text string")
    th = {(r.doc_id, r.text): r.th for r in lines.documents(df).collect()}
    place = defaultdict(list)
    for d, t in set(rows):
        for no, line in enumerate((t or "").split("\n")):
            if k := re.sub(r"[\W_]+", " ", line.lower()).strip(" "):
                place[k].append(((d is not None, d or 0), th[d, t], no))
    up = {k: k for k in place}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = [k for k in place if lines.word_count(k) >= 5]
    prints = {k: (plain_fingerprints(k), len(k)) for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if met(prints[a], prints[b]) and 5 * edit(a, b) <= max(len(a), len(b)):
                up[top(a)] = top(b)
    first = {}
    for k, where in place.items():
        first[top(k)] = min(first.get(top(k), where[0]), *where)
    gone = {w for k, where in place.items() for w in where if w != first[top(k)]}
    out = Counter()
    for d, t in rows:
        if t is None:
            out[d, 0, 0, None] += 1
            continue
        parts = t.split("\n")
        left = [x for i, x in enumerate(parts) if ((d is not None, d or 0), th[d, t], i) not in gone]
        out[d, len(parts), len(parts) - len(left), "\n".join(left)] += 1
    return out


def fuzzy_rows():
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi"]) + str(rng.randrange(40)) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(70):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(30)] = rng.choice(["zeta", "mu", "w1"])
        rows.append((i, f"Head, {i % 9}!\n{' '.join(w)}\n\n--\n{rng.choice(base).upper()}."))
    return rows


LINES = ("doc_id", "n_lines", "n_removed", "kept")


def test_lines_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "a\nA!\n\n***\n a "), (3, "a\nother"), (None, "a"), (4, "É x\né X"), (9, "w " * 30000)] + [(10 + i, t) for i, t in fuzzy_rows()]
    got = rows_of(lines.dedup_lines(docs(rows)), *LINES)
    assert got == line_groups(spark, rows)
    assert lines.dedup_lines(docs([])).count() == 0


def test_fuzzy_lines_are_found(docs):
    rng = random.Random(6)
    base = [f"word{rng.randrange(3000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        w[rng.randrange(300)] = "other"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(rows)).collect()}
    assert got[0] == 0 and sum(got.values()) >= 35


def test_lines_in_the_pipeline_form(docs):
    got = lines.replace_texts(docs([(1, "a b\nc"), (2, "A b!"), (3, None), (4, "")]))
    assert rows_of(got, "doc_id", "text", "segment") == Counter([(1, "a b\nc", 1), (3, None, 1), (4, "", 1)])


def check_layout(got, rows, n=40):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_rows(docs):
    rows = [(i, f"t{i}") for i in range(95)] + [(3, "t3"), (None, None), (None, ""), (200, LONG)]
    check_layout(shuffle.layout(docs(rows)).collect(), rows)
    check_layout(shuffle.layout(docs(rows[:3])).collect(), rows[:3])
    assert shuffle.layout(docs([])).count() == 0


def test_shards_query(spark, sf, corpus_rows):
    got = queries.op7_shards(spark, sf).collect()
    check_layout(got, corpus_rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:])) < 0.6 * len(order)


CHAT = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def conversations(rows):
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    out = Counter()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()), len(loss), sha(loss.encode())] += 1
    return out


def test_chat_rows(spark):
    rng = random.Random(8)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "<s>", "[TEXT]", "[ROLE]", "[/ROLE]", "<", "[", "/", "a", "é\n", " ", "\\\\"]
    rows = []
    for c in range(120):
        for n in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "to\\ol[TEXT]", None, ""]) if n > 1 else ["user", "assistant"][n]
            rows.append((c, n, role, rng.choice(["hello", None, "".join(rng.choice(bits) for _ in range(9))]) if n else rng.choice(["hi", "a [INST]"])))
    rows += [(500, 0, "user", "x" * 50000), (500, 1, "assistant", "y"), (501, 0, "user", "x" * 50000), (None, None, "user", "q"), (None, 1, None, "r"), (7, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    packed = chat.sequences(df, limit=400)
    assert rows_of(chat.read_back(packed), *CHAT) == conversations(rows)
    assert chat.formatted(df.limit(0)).count() == 0
    whole = 0
    for s in packed.collect():
        for leaf in s.leaves:
            path, k = [], leaf.node
            while k >= 0:
                path.append(k)
                k = s.nodes[k].parent
            text = "".join(s.text[s.nodes[k].start:s.nodes[k].end] for k in reversed(path))
            assert len(chat.read(text)) == len(path)
            whole += len(text)
            # the ancestors' intervals hold the path before the turn, and positions follow it
            n = s.nodes[leaf.node]
            assert "".join(s.text[a.start:a.end] for a in n.attends) + s.text[n.start:n.end] == text
            assert n.position == len(text) - (n.end - n.start)
        tops = [n.attends for n in s.nodes if n.parent < 0]
        assert not any(tops)
    assert sum(len(s.text) for s in packed.collect()) < whole


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = queries.op8_chat(spark, sf)
    assert rows_of(got, *CHAT) == conversations(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {r.conv_id: r.loss_chars for r in got.where("conv_id = -7").collect()} == {-7: len(said)}


def page(body, host="a.example"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>", f"https://{host}/x"


PAGES = [
    (page("<nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>t</b>wo<p>three&nbsp;x<br>four</article><footer>f</footer>"), "A & B one two three x four"),
    (page('<header>top</header><main><header><h1>H</h1></header><p>a</p><div class="share-bar">s</div></main><aside>z</aside>'), "H a"),
    (page('<div id="content" class="has-sidebar"><h1>t</h1><p>x<script>if (a<b) "</p>"</script> y</p><form>q<input></form></div><section id="comments"><p>c</p></section>'), "t x y"),
    (page("<p>5 < 6 &lt;tag&gt; &#233;&eacute; &amp</p><ul><li>1<li>2</ul><!-- c > d --><table><tr><td>u<td>v</table>"), "5 < 6 <tag> éé & 1 2 u v"),
    (("<article><p>cut off <b>here</b> &am", None), "cut off here &am"),
    (("<p>left <a href='x", "not a url"), "left"),
    ((None, None), ""),
    (("", ""), ""),
    (("plain\n\n text", "http://b.example"), "plain text"),
    (("<div class='cookie-notice'>k</div>body<style>unclosed p{}", "http://b.example"), "body"),
]


def test_pages_rows(spark):
    rows = [(i, url, html, "x", "y") for i, ((html, url), _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, key string").repartition(3)
    got = pages.main_text(df)
    assert rows_of(got, "page_id", "text", "n_chars") == Counter((i, t, len(t)) for i, (_, t) in enumerate(PAGES))
    assert pages.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_site_templates_go(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(pages, "BROADCAST_HASHES", bound)
    rows = [(i, f"http://s.example/{i}", page(f"<div><span>Read us daily</span></div><article><p>story {i}</p><p>Licence line</p></article><div>own {i}</div>")[0]) for i in range(30)]
    rows += [(100 + i, f"http://t{i}.example/", page("<div><span>Read us daily</span></div>")[0]) for i in range(30)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"story {i} Licence line own {i}" for i in range(30)} | {100 + i: "Read us daily" for i in range(30)}


def test_pages_query(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op1_pages(spark, sf).collect()
    import html as entities
    assert len(got) == len(html)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r.page_id], re.S)
        inner = re.sub(r"<[a-zA-Z/][^>]*\Z", "", inner[1])
        assert r.text == " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br|b)>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
