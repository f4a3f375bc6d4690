"""SimHash near-duplicates: meet-in-the-middle ball hashing.

Two fingerprints within distance 4 share a variant: a fingerprint that differs from either in 2 bits at most. Every
fingerprint therefore emits all variants within half the radius, variants are shuffled together, and fingerprints
that meet on one are linked. Variants travel in a compact form: the shuffle key is the leading bits of the variant, a
fingerprint goes once to each key that any of its variants has, and the receiving task writes the variants out.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, lines, shared
from labelloom.llm.arrays import majority
from labelloom.llm.buckets import small
from labelloom.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
BITS = 64
#: Of the pipeline's near-dedup: words of a shingle, Jaccard similarity, and pairs of 64-bit fingerprints that find candidates.
KEEP_WORDS = 5
SIMILARITY = 0.8
PAIRS = 5
#: Counters by which shingles are put in order, and tables of them that are added separately.
COUNTERS, TABLES = 1 << 18, 64
#: Variants sorted at a time inside a task.
TASK_VARIANTS = 1 << 21


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words, or of all words where there are fewer."""
    words = text.lower().split()  # splits at 0x20 and 0x09-0x0D; lower() of bytes changes A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], np.uint64)


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp bigint) of every row; a text without words has fingerprint 0."""
    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            raw = buf.tobytes()
            parts = [shingle_hashes(raw[a:b], width) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            fp = majority(np.concatenate(parts), first)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    return shared.texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def _masks(bits: int, most: int) -> np.ndarray:
    """All flips of up to ``most`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(bits), r)], np.uint64)


def _contract(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the component of each of n nodes under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _meet(fps: np.ndarray, key: int, prefix_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints sent to one key, as a spanning forest.

    A variant held by m fingerprints gives m - 1 links to the first of them: any two that share a variant are within
    the radius, so no connection is lost and no group is paired out.
    """
    fps = np.unique(fps)
    low_bits = BITS - prefix_bits
    keep = np.uint64((1 << low_bits) - 1)
    base = (fps & keep) | np.uint64(key << low_bits)
    used = np.array([int(x).bit_count() for x in (fps >> np.uint64(low_bits)) ^ np.uint64(key)])
    groups = [(np.flatnonzero(used == d), _masks(low_bits, half - d)) for d in range(half + 1)]
    total = sum(len(g) * len(m) for g, m in groups)
    slices = -(-total // TASK_VARIANTS)  # of the variants, by hash, so that memory stays bounded in a dense ball
    left, right = [], []
    for r in range(slices):
        variants, owner = [], []
        for who, masks in groups:
            step = max(1, TASK_VARIANTS // len(masks))
            for s in range(0, len(who), step):
                w = who[s:s + step]
                v = (base[w][:, None] ^ masks[None, :]).ravel()
                o = np.repeat(w, len(masks))
                if slices > 1:
                    mine = arrays.mix(v) % np.uint64(slices) == r
                    v, o = v[mine], o[mine]
                variants.append(v)
                owner.append(o)
        v, o = np.concatenate(variants), np.concatenate(owner)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if len(same):
            head = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(len(v)), 0))
            pairs = np.unique(np.stack([o[head[same + 1]], o[same + 1]], 1), axis=0)
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    far = np.array([int(x).bit_count() for x in fps[a] ^ fps[b]])
    assert (far <= 2 * half).all()  # the verification: never more than the radius apart
    label = _contract(a, b, len(fps))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[moved]], fps[moved]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) links whose components are those of all pairs within ``radius`` bits."""
    spark, half = distinct.sparkSession, radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    n = distinct.count()
    per = len(_masks(BITS, half))
    prefix_bits = min(24, max(4, (n * per // TASK_VARIANTS).bit_length()))
    flips = _masks(prefix_bits, half).astype(np.int64)

    def scatter(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), 4096):
                x = fp[s:s + 4096]
                keys = (x >> np.uint64(BITS - prefix_bits)).astype(np.int64)[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(x.view(np.int64), len(flips)))], ["key", "fp"])

    def gather(batches):
        key, held = None, []

        def flush():
            a, b = _meet(np.concatenate(held).view(np.uint64), key, prefix_bits, half)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and keys[s] != key:
                    yield flush()
                    held = []
                key = int(keys[s])
                held.append(fp[s:e])
        if held:
            yield flush()

    parts = shared.partitions(spark, n * len(flips) * 16)
    sent = distinct.select("fp").mapInArrow(scatter, "key bigint, fp bigint")
    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(gather, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text).

    component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer. Null and empty texts have
    fingerprint zero and link like any other. A null doc_id never becomes a component_id unless its whole group has
    none. Rows repeated under one doc_id are returned as often as they come. Extra columns are ignored.
    """
    fps = shared.materialise(fingerprints(docs, width))
    distinct = shared.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = shared.materialise(rooted.join(lows, "root").select(F.col("fp").alias("f"), "component_id"))
    return fps.join(named, fps.fp == named.f).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprints(texts: DataFrame, width: int, pairs: int = PAIRS) -> DataFrame:
    """(id, n_chars, f1, f2 ...) of every row of (id, text): the number of different shingles and SimHash fingerprints of their set."""
    names = [f"f{k}" for k in range(1, 2 * pairs + 1)]

    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            raw = buf.tobytes()
            sets = [np.unique(shingle_hashes(raw[a:b], width)) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            first = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int64)
            hashes = np.concatenate(sets)
            prints = []
            for _ in names:
                prints.append(pa.array(majority(hashes, first).view(np.int64)))
                hashes = arrays.mix(hashes ^ np.uint64(HASH_SEED))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), *prints], ["id", "n_chars", *names])
    return shared.texts(texts, "id").mapInArrow(run, "id bigint, n_chars bigint, " + ", ".join(f"{n} bigint" for n in names))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, sketch) of every row of (id, text): its sorted set of shingle hashes."""
    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            raw = buf.tobytes()
            sets = [np.unique(shingle_hashes(raw[a:b], width)).view(np.int64) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "sketch"])
    return shared.texts(texts, "id").mapInArrow(run, "id bigint, sketch array<bigint>")


def bits_apart(similarity: float) -> int:
    """Bits of a pair of fingerprints in which sets of this Jaccard similarity or more differ at most: four deviations above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(2 * BITS * p + 4 * math.sqrt(2 * BITS * p * (1 - p)))


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """About how often each shingle occurs in (id, text): COUNTERS sums, each of the shingles with one remainder."""
    def count(batches):
        n = np.zeros(COUNTERS, np.int64)
        for _, buf, off in arrays.chunks(batches):
            raw = buf.tobytes()
            hashes = np.concatenate([shingle_hashes(raw[a:b], width) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            n += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TABLES), pa.int64()), pa.array([x.tobytes() for x in n.reshape(TABLES, -1)], pa.binary())], ["part", "rows"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
                sums[k] = sums.get(k, 0) + np.frombuffer(rows.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "rows"])

    total = np.zeros((TABLES, COUNTERS // TABLES), np.int64)
    for r in shared.texts(texts, "id").mapInArrow(count, "part bigint, rows binary").repartition("part").mapInArrow(add, "part bigint, rows binary").collect():
        total[r.part] += np.frombuffer(r.rows, np.int64)
    return total.ravel()


def prefix_pairs(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) pairs of ids of (id, text, label) with different labels: among them all whose sets of shingles reach ``similarity``.

    Sets that alike share one of the first shingles of each, in any order of all shingles; rare ones come first here. What
    follows the shared shingle must be able to reach the similarity too.
    """
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(shingle_counts(texts, width))
    row = np.dtype([("token", "<u8"), ("id", "<i8"), ("label", "<i8"), ("n", "<i4"), ("at", "<i4")])
    size = int(shared.text_bytes(texts) * (1 - similarity) * row.itemsize / width) + 1  # a word has about ``width`` bytes
    parts = -(-size // lines.PART_BYTES)

    def scatter(batches):
        for rows, buf, off in arrays.chunks(batches):
            raw, label, held = buf.tobytes(), rows.column("label").to_numpy(), {}
            for i, (d, a, b) in enumerate(zip(rows.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist())):
                if d in held or a == b:
                    continue
                h = np.unique(shingle_hashes(raw[a:b], width))
                h = h[np.argsort(order.value[(h % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")]
                first = h[:len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                out = np.empty(len(first), row)
                out["token"], out["id"], out["label"], out["n"], out["at"] = first, d, label[i], len(h), np.arange(len(first))
                held[d] = out
            if held:
                out = np.concatenate(list(held.values()))
                yield arrays.deal((arrays.mix(out["token"]) % np.uint64(parts)).astype(np.int64), out)

    def gather(batches):
        for rows in arrays.dealt(batches, row):
            rows = rows[np.lexsort((rows["n"], rows["token"]))]
            begin = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
            mixed = np.minimum.reduceat(rows["label"], begin) != np.maximum.reduceat(rows["label"], begin)
            rows = rows[np.repeat(mixed, np.diff(np.append(begin, len(rows))))]
            if not len(rows):
                continue
            token, n, rest, label, ids = rows["token"], rows["n"].astype(np.int64), (rows["n"] - rows["at"]).astype(np.int64), rows["label"], rows["id"]
            key = (np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) << 32) + n
            reach = np.searchsorted(key, (key >> 32 << 32) + np.floor(n / similarity + 1e-6).astype(np.int64), "right") - np.arange(len(n))
            d, at, held, n_held = 1, np.flatnonzero(reach > 1), [], 0
            while len(at):
                able = np.minimum(rest[at], rest[at + d]) >= similarity / (1 + similarity) * (n[at] + n[at + d]) - 1e-6
                p = at[able & (label[at] != label[at + d])]
                held.append(np.stack([np.minimum(ids[p], ids[p + d]), np.maximum(ids[p], ids[p + d])], 1))
                n_held += len(p)
                d += 1
                at = at[reach[at] > d]
                if n_held > lines.TASK_PAIRS or not len(at):
                    pairs = np.unique(np.concatenate(held), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                    held, n_held = [], 0

    sent = texts.select(F.col("id").alias("doc_id"), "text", "label").mapInArrow(scatter, "part bigint, rows binary")
    return sent.repartition(shared.partitions(spark, size), "part").sortWithinPartitions("part").mapInArrow(gather, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, id, component_id, keep_id) of every row: a hash of its text, the smallest doc_id of its group, and a text of that one."""
    rows = shared.texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("id", F.xxhash64("text"))
    owners = shared.materialise(rows.groupBy("id").agg(F.min("doc_id").alias("low")))
    prints = shared.materialise(wide_fingerprints(rows.select("id", "text"), width).dropDuplicates(["id"]))
    groups = [[f"f{k}", f"f{k + 1}"] for k in range(1, 2 * PAIRS + 1, 2)]
    names, most = sum(groups, []), bits_apart(similarity)

    def verify(pairs: DataFrame) -> DataFrame:
        ids = shared.materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        sets = shared.materialise(shingle_sets(rows.join(small(ids), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), width))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= (F.size("x") + F.size("y") - common) * F.lit(similarity - 1e-9)).select("a", "b")

    found = lines.linked(prints.where("n_chars > 0").select("id", "n_chars", F.lit(0).alias("kind"), F.col("id").alias("label"), *names), verify, groups, most, similarity)
    # what no block shows: pairs that share a rare shingle and are within the same bits
    roots = shared.materialise(components(found))
    pairs = shared.materialise(prefix_pairs(rows.join(small(roots), rows.id == roots.node, "left").select("id", "text", F.coalesce("root", "id").alias("label")), width, similarity))
    for c in "ab":
        pairs = pairs.join(prints.select(F.col("id").alias(c), *[F.col(f).alias(f"{c}{f}") for f in names]), c)
    near = [F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) + F.bit_count(F.col(f"a{g}").bitwiseXOR(F.col(f"b{g}"))) for f, g in groups]
    further = shared.materialise(verify(shared.materialise(pairs.where(F.least(*near) <= most).select("a", "b"))))
    # texts without words are alike
    none = prints.where("n_chars = 0").select("id")
    empty = none.join(F.broadcast(none.agg(F.min("id").alias("a"))), F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
    roots = components(found.union(further).union(empty))
    rooted = owners.join(roots, owners.id == roots.node, "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lows = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "id")).alias("first"))
    named = shared.materialise(rooted.join(lows, "root").select(F.col("id").alias("i"), F.col("first.low").alias("component_id"), F.col("first.id").alias("keep_id")))
    return rows.select("doc_id", "id").join(named, F.col("id") == F.col("i")).select("doc_id", "id", "component_id", "keep_id")


def similar_texts(docs: DataFrame, width: int = KEEP_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of (doc_id, text).

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles reaches ``similarity``; texts without
    words are alike. SimHash says which are candidates: texts within ``bits_apart`` in one of the pairs of fingerprints. Those
    that agree in two blocks of one fingerprint are found by ``lines``, the others by the rare shingles that they share; the
    sets then verify every link. component_id is the smallest doc_id of the connected group.
    """
    return _grouped(docs, width, similarity).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of similar texts: the one with the smallest doc_id, and of its texts in the
    group the one with the smallest hash. Rows alike in doc_id and text are one document; another text under the same doc_id
    is judged by its own group."""
    keep = _grouped(docs, KEEP_WORDS, SIMILARITY).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("id") == F.col("keep_id")))
    keep = keep.select(F.col("doc_id").alias("kept_doc"), F.col("id").alias("kept_text")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(keep, docs["doc_id"].cast("bigint").eqNullSafe(keep["kept_doc"]) & (text == keep["kept_text"]), "left_semi")
