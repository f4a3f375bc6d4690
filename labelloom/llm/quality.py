"""Quality verdicts: counts per document, two base rules, and gradient-boosted trees over the counts.

The trees are trained here on a bounded sample of labelled rows, with monotonic constraints on the features that can
only speak against a text, and flattened into node arrays that score a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import arrays, shared

#: Labelled rows used for training at most: those with the smallest hashes of their id.
TRAIN_ROWS = 20_000
MIN_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
THRESHOLD = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_shouts", "n_distinct", "n_bars"]
#: Feature -> direction in which the chance of good quality may move with it (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0, "stops": 0, "shouts": -1, "distinct": 0, "line_words": 0, "bars": -1}


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key in the same text, has an earlier one there)."""
    k = arrays.mix(keys ^ arrays.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    later = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
    any_, after = np.zeros(len(s), bool), np.zeros(len(s), bool)
    after[order] = later
    any_[order] = later | np.concatenate([later[1:], [False]]) if len(s) else later
    return any_, after


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of every row."""
    def run(batches):
        for rows, buf, off in arrays.chunks(batches):
            space = arrays.SPACE[buf]
            start, end = arrays.spans(~space, off)
            first = arrays.counts_in(off, start)
            owner = arrays.owners(first)
            sums = arrays.BYTES.sums(arrays.BYTES.symbols[buf])
            words = arrays.BYTES.span(sums, start, end)
            per_byte = lambda m: arrays.segment_sum(m, off)
            # windows of five words that the text has twice or more
            win = arrays.windows(first, REPEAT_WINDOW)
            wsums = arrays.WORDS.sums(words)
            twice, _ = _repeated(arrays.WORDS.span(wsums, win, win + REPEAT_WINDOW), owner[win])
            inside = arrays.cover(win[twice], win[twice] + REPEAT_WINDOW, len(words))
            _, again = _repeated(words, owner)
            # lines with a word that equal an earlier line
            lstart, lend = arrays.spans(buf != 10, off)
            filled = np.concatenate([[0], np.cumsum(~space)])
            has = filled[lend] > filled[lstart]
            lstart, lend = lstart[has], lend[has]
            lfirst = arrays.counts_in(off, lstart)
            _, dup = _repeated(arrays.BYTES.span(sums, lstart, lend), arrays.owners(lfirst))
            out = [np.diff(first), per_byte(arrays.LEAD[buf] & ~space), per_byte(SYMBOL[buf]), arrays.segment_sum(dup, lfirst), arrays.segment_sum(inside, first),
                   np.diff(lfirst), per_byte(UPPER[buf]), per_byte(DIGIT[buf]), per_byte(STOP[buf]), per_byte(buf == 33), np.diff(first) - arrays.segment_sum(again, first), per_byte(buf == 124)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in out)], ["doc_id", *COUNTS])
    return shared.texts(docs).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
                     c["n_digits"] / chars, c["n_stops"] / words, c["n_shouts"] / words, c["n_distinct"] / words, c["n_words"] / lines, c["n_bars"] / words], 1)


@dataclass
class Trees:
    """Complete binary trees as arrays (tree, node): children of node k are 2k + 1 and 2k + 2; leaves are the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, sign: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_hess: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins.

    A split of a constrained feature needs child values in the allowed order, and the midpoint of the two values bounds
    everything below either child; so the score is monotonic in the feature as a whole.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    rate_of = y.mean().clip(1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    trees, total = [], np.full(n, base)
    for _ in range(n_trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                low[2 * k + 1:2 * k + 3], high[2 * k + 1:2 * k + 3] = low[k], high[k]
                mine = node == k
                gk, hk, bk = g[mine], h[mine], binned[mine]
                best = 1e-9
                for j in range(m):
                    if not len(edges[j]) or not len(gk):
                        continue
                    gl = np.cumsum(np.bincount(bk[:, j], gk, bins))[:len(edges[j])]
                    hl = np.cumsum(np.bincount(bk[:, j], hk, bins))[:len(edges[j])]
                    gr, hr = gk.sum() - gl, hk.sum() - hl
                    vl, vr = (-gl / (hl + l2)).clip(low[k], high[k]), (-gr / (hr + l2)).clip(low[k], high[k])
                    gain = -(gl * vl + (hl + l2) * vl ** 2 / 2 + gr * vr + (hr + l2) * vr ** 2 / 2)
                    v = (-gk.sum() / (hk.sum() + l2)).clip(low[k], high[k])
                    gain += gk.sum() * v + (hk.sum() + l2) * v ** 2 / 2
                    ok = (hl >= min_hess) & (hr >= min_hess) & ((sign[j] == 0) | (sign[j] * (vr - vl) >= 0))
                    gain = np.where(ok, gain, 0)
                    if (i := int(gain.argmax())) >= 0 and gain[i] > best:
                        best, feature[k], threshold[k], cut[k] = gain[i], j, edges[j][i], i
                        mid = (vl[i] + vr[i]) / 2
                        low[2 * k + 1:2 * k + 3], high[2 * k + 1:2 * k + 3] = low[k], high[k]
                        if sign[j] > 0:
                            high[2 * k + 1], low[2 * k + 2] = mid, mid
                        elif sign[j] < 0:
                            low[2 * k + 1], high[2 * k + 2] = mid, mid
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        value = -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        value = rate * value.clip(low[inner:], high[inner:])
        trees.append((feature, threshold, value))
        total += value[at]
    stack = [np.stack(c) for c in zip(*trees)] if trees else [np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))]
    return Trees(*stack, base, depth)


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled rows (doc_id, quality), chosen by a hash of the id and so alike on every run.

    The bound holds for the joined rows: repeated ids on either side do not multiply what the driver receives.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    picked = stats.select("doc_id", *COUNTS).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *COUNTS).limit(rows)
    sample = picked.toPandas().sort_values(["doc_id", "quality", *COUNTS], kind="stable")
    return fit(features({c: sample[c].to_numpy() for c in COUNTS}), sample["quality"].to_numpy(float), np.array(list(FEATURES.values())))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept), one row per row of (doc_id, text).

    A null or empty text has no words and fails the base rules. Without any labelled row the trees score one half, which
    keeps what passes the base rules. Repeated rows are judged one by one; extra columns are ignored.
    """
    stats = shared.materialise(statistics(docs))
    sent = docs.sparkSession.sparkContext.broadcast(train(stats, labels))

    def run(batches):
        for b in batches:
            p = sent.value.score(features({c: b.column(c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "score"])

    scored = stats.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` of whose doc_id every row is kept."""
    bad = verdicts(docs, labels).where("not kept").select("doc_id").distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id), "left_anti")
