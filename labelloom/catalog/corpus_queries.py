"""Queries over raw and cleaned corpora: scans, cleaning, duplicates, audits, lengths, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import settings
from labelloom.catalog import sqltext as q
from labelloom.catalog.registry import query
from labelloom.catalog.tables import Tables

from labelloom.functions import text as tx
from labelloom.operators import audit, cleaning, dedupe, split, tfidf
from labelloom.plans import preprocess
from labelloom.sources import corpus

ANN = q.annotated()


@query("scan_corpus", f"WITH {q.LABELLED} SELECT row_id, text, CAST(label AS INTEGER) AS label FROM lab")
def scan_corpus(t: Tables):
    raw = t.labelled().select(F.col("row_id").alias("Unnamed: 0"), F.col("text").alias("Sentences"),
                              F.col("label").cast("double").alias("Sentiment"))
    return corpus.canonical(raw)


NA_LIST = ", ".join("'" + v + "'" for v in settings.NA_TOKENS)


@query("scan_null_tokens", f"""
SELECT doc_id AS row_id, CASE WHEN raw NOT IN ({NA_LIST}) THEN raw END AS text
FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'NA' WHEN doc_id % 17 = 1 THEN 'null'
                          WHEN doc_id % 17 = 2 THEN '' ELSE text END AS raw FROM documents)""")
def scan_null_tokens(t: Tables):
    m = F.col("row_id") % 17
    raw = F.when(m == 0, "NA").when(m == 1, "null").when(m == 2, "").otherwise(F.col("text"))
    return t.texts().select("row_id", tx.null_tokens_to_null(raw).alias("text"))


@query("clean_text", f"""
SELECT doc_id AS row_id, {q.clean("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END")} AS text FROM documents""")
def clean_text(t: Tables):
    holes = t.texts().withColumn("text", F.when(F.col("row_id") % 17 != 0, F.col("text")))
    return cleaning.clean_rows(holes)


@query("clean_drop_empty", f"""
SELECT * FROM (SELECT doc_id AS row_id, {q.clean("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END")} AS text
               FROM documents) WHERE text <> ''""")
def clean_drop_empty(t: Tables):
    return cleaning.drop_empty(clean_text(t))


@query("normalize_labels", """
SELECT row_id, CAST(raw + 1 AS INTEGER) AS label
FROM (SELECT doc_id AS row_id, CAST(doc_id % 4 AS INTEGER) - 1 AS raw FROM documents) WHERE raw IN (-1, 0, 1)""")
def normalize_labels(t: Tables):
    return cleaning.normalize_labels(t.annotated(4).select("row_id", "label"))


@query("label_names", f"""
WITH {q.LABELLED} SELECT row_id, label, {q.NAME} AS label_name
FROM (SELECT row_id, CAST(label + 1 AS INTEGER) AS label FROM lab)""")
def label_names(t: Tables):
    return cleaning.with_label_names(t.truth().select("row_id", "label"))


# Duplicates and conflicts.

@query("dedupe_exact", f"WITH {ANN} SELECT text, label, min(row_id) AS row_id FROM ann GROUP BY text, label")
def dedupe_exact(t: Tables):
    return dedupe.dedupe_exact(t.annotated())


@query("conflict_texts", f"""
WITH {ANN} SELECT text, min(label) AS min_label, max(label) AS max_label, count(*) AS n_rows
FROM ann GROUP BY text HAVING count(DISTINCT label) > 1""")
def conflict_texts(t: Tables):
    return dedupe.conflict_texts(t.annotated())


@query("conflict_rows", f"""
WITH {ANN} SELECT row_id, text, label FROM ann
WHERE text IN (SELECT text FROM ann GROUP BY text HAVING count(DISTINCT label) > 1)""")
def conflict_rows(t: Tables):
    return dedupe.conflict_rows(t.annotated())


@query("drop_conflicts", f"""
WITH {ANN}, d AS (SELECT text, label, min(row_id) AS row_id FROM ann GROUP BY text, label)
SELECT text, label, row_id FROM d
WHERE text NOT IN (SELECT text FROM ann GROUP BY text HAVING count(DISTINCT label) > 1)""")
def drop_conflicts(t: Tables):
    return dedupe.drop_conflicts(dedupe.dedupe_exact(t.annotated()))


@query("resolve_duplicates", f"""
WITH {ANN}, cln AS (SELECT row_id, {q.clean('text')} AS text, label FROM ann)
SELECT min(row_id) AS row_id, text, min(label) AS label FROM cln WHERE text <> ''
GROUP BY text HAVING count(DISTINCT label) = 1""")
def resolve_duplicates(t: Tables):
    return dedupe.resolve_duplicates(cleaning.drop_empty(cleaning.clean_rows(t.annotated())))


@query("dup_group_rows", f"""
WITH {ANN} SELECT row_id, text, label FROM
(SELECT *, count(*) OVER (PARTITION BY text, label) AS n FROM ann) WHERE n > 1""")
def dup_group_rows(t: Tables):
    return dedupe.dup_group_rows(t.annotated())


@query("repeat_rows", f"""
WITH {ANN} SELECT row_id, text, label FROM
(SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY row_id) AS r FROM ann) WHERE r > 1""")
def repeat_rows(t: Tables):
    return dedupe.repeat_rows(t.annotated())


@query("samples_per_class", f"""
WITH {q.LABELLED} SELECT row_id, text, label, CAST(position AS INTEGER) AS position FROM
(SELECT row_id, text, CAST(label AS INTEGER) AS label,
        row_number() OVER (PARTITION BY label ORDER BY row_id) AS position FROM lab) WHERE position <= 10""")
def samples_per_class(t: Tables):
    return dedupe.samples_per_class(t.labelled(), 10)


@query("duplicate_audit", f"""
WITH {ANN}, p AS (SELECT text, label, count(*) AS n FROM ann GROUP BY text, label),
x AS (SELECT text, sum(n) AS n, count(*) AS pairs, count(label) AS labels FROM p GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - pairs) AS BIGINT) AS exact_repeats,
       CAST(sum(n - 1) AS BIGINT) AS text_repeats, CAST(sum(pairs - 1) AS BIGINT) AS text_minus_exact,
       count(*) FILTER (labels > 1) AS conflict_texts, CAST(sum(pairs) AS BIGINT) AS rows_after_exact,
       CAST(sum(CASE WHEN labels <= 1 THEN pairs ELSE 0 END) AS BIGINT) AS rows_after_conflicts FROM x""")
def duplicate_audit(t: Tables):
    return audit.duplicate_audit(t.annotated())


@query("label_conflict_pairs", f"""
WITH {ANN}, d AS (SELECT DISTINCT text, label FROM ann),
dim AS (SELECT CAST(v AS INTEGER) - 1 AS l FROM range(3) r(v)),
pr AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM d a JOIN d b ON a.text = b.text AND a.label <> b.label
       GROUP BY 1, 2)
SELECT x.l AS label_a, y.l AS label_b, coalesce(n, 0) AS n
FROM dim x CROSS JOIN dim y LEFT JOIN pr ON pr.la = x.l AND pr.lb = y.l""")
def label_conflict_pairs(t: Tables):
    return audit.label_conflict_pairs(t.annotated())


# Audits.

@query("class_distribution", f"""
WITH {q.LABELLED}, dim AS (SELECT CAST(v AS INTEGER) - 1 AS label FROM range(3) r(v))
SELECT dim.label, count(lab.row_id) AS n,
       round(count(lab.row_id) * 100.0 / CAST((SELECT count(*) FROM lab) AS DOUBLE), 2) AS pct
FROM dim LEFT JOIN lab ON lab.label = dim.label GROUP BY dim.label""")
def class_distribution(t: Tables):
    return audit.class_distribution(t.labelled(), settings.RAW_LABELS)


_NOISE_SQL = {
    "http_url": r"https?://\S+", "www_url": r"www\.\S+", "mention": r"@[\p{L}\p{N}_]+",
    "hashtag": r"#[\p{L}\p{N}_]+", "latin": "[A-Za-z]", "digit": r"\p{Nd}",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "blank": r"\A\s*\z",
}


@query("noise_audit", f"WITH {q.WITH_URLS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS n, "
    f"round(count(*) FILTER (regexp_matches(text, '{p}')) * 100.0 / CAST(count(*) AS DOUBLE), 4) AS pct FROM urls"
    for name, p in _NOISE_SQL.items()))
def noise_audit(t: Tables):
    return audit.noise_audit(t.texts_with_urls())


@query("null_counts", """
WITH h AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS text,
                  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS label FROM documents)
SELECT 'row_id' AS "column", count(*) FILTER (doc_id IS NULL) AS nulls FROM h
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM h
UNION ALL SELECT 'label', count(*) FILTER (label IS NULL) FROM h""")
def null_counts(t: Tables):
    row = F.col("row_id")
    return audit.null_counts(t.texts().select(
        "row_id", F.when(row % 17 != 0, F.col("text")).alias("text"), F.when(row % 5 != 0, row).alias("label")))


def _share(pattern: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"


_DEVANAGARI, _LATIN, _DIGIT, _SPACE = (
    _share(p) for p in (r"[\x{0900}-\x{097F}]", "[A-Za-z]", r"\p{Nd}", r"\s"))


@query("script_mix", f"""
WITH c AS (SELECT length(text) AS len, {_DEVANAGARI} AS dev, {_LATIN} AS lat, {_DIGIT} AS dig, {_SPACE} AS ws
           FROM documents)
SELECT round(avg(dev / CAST(greatest(len, 1) AS DOUBLE)) * 100, 4) AS devanagari,
       round(avg(lat / CAST(greatest(len, 1) AS DOUBLE)) * 100, 4) AS latin,
       round(avg(dig / CAST(greatest(len, 1) AS DOUBLE)) * 100, 4) AS digit,
       round(avg(ws / CAST(greatest(len, 1) AS DOUBLE)) * 100, 4) AS whitespace,
       round(avg((len - dev - lat - dig - ws) / CAST(greatest(len, 1) AS DOUBLE)) * 100, 4) AS other FROM c""")
def script_mix(t: Tables):
    return audit.script_mix(t.texts())


# Lengths.

@query("length_summary", f"""
WITH {q.LENGTHS} SELECT unit, count(*) AS n_rows, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std,
  CAST(min(length) AS INTEGER) AS min, round(quantile_cont(length, 0.5), 6) AS p50,
  round(quantile_cont(length, 0.9), 6) AS p90, round(quantile_cont(length, 0.95), 6) AS p95,
  round(quantile_cont(length, 0.99), 6) AS p99, CAST(max(length) AS INTEGER) AS max FROM len GROUP BY unit""")
def length_summary(t: Tables):
    return audit.length_summary(audit.length_counts(t.texts()))


@query("truncation_share", f"WITH {q.LENGTHS} SELECT unit, " + ", ".join(
    f"round(count(*) FILTER (length > {k}) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS pct_over_{k}"
    for k in settings.LENGTH_CUTOFFS) + " FROM len GROUP BY unit")
def truncation_share(t: Tables):
    return audit.truncation_share(audit.length_counts(t.texts()))


@query("recommend_max_length", f"""
WITH {q.LENGTHS}, p AS (SELECT unit, quantile_cont(length, 0.99) AS p99 FROM len GROUP BY unit),
s AS (SELECT unit, p99, CAST(64 AS INTEGER) AS current, CAST(ceil(p99 / 32) * 32 AS INTEGER) AS suggested FROM p)
SELECT unit, round(p99, 6) AS p99, current, suggested,
       CASE WHEN suggested < current THEN round((1 - suggested / CAST(current AS DOUBLE)) * 100, 4) ELSE 0.0::DOUBLE END
         AS saving_pct,
       CASE WHEN suggested < current THEN 'shrink' WHEN suggested > current THEN 'grow' ELSE 'keep' END AS advice
FROM s""")
def recommend_max_length(t: Tables):
    return audit.recommend_max_length(audit.length_counts(t.texts()))


@query("length_histogram", f"""
WITH {q.LENGTHS}, p AS (SELECT unit, CAST(floor(quantile_cont(length, 0.99)) AS INTEGER) AS cap FROM len GROUP BY unit),
c AS (SELECT len.unit, least(length, cap) AS x FROM len JOIN p ON len.unit = p.unit),
m AS (SELECT unit, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END::DOUBLE AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END::DOUBLE AS hi FROM c GROUP BY unit),
b AS (SELECT m.unit, lo, (hi - lo) / 50 AS width, CAST(v AS INTEGER) AS bin FROM m CROSS JOIN range(50) r(v)),
h AS (SELECT c.unit, CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
      FROM c JOIN m ON c.unit = m.unit GROUP BY 1, 2)
SELECT b.unit, b.bin, round(lo + b.bin * width, 6) AS left_edge, coalesce(n, 0) AS n
FROM b LEFT JOIN h ON h.unit = b.unit AND h.bin = b.bin""")
def length_histogram(t: Tables):
    return audit.length_histogram(audit.length_counts(t.texts()))


# Splits.

_RESOLVED4 = f"{q.annotated(4)}, {q.resolved('ann')}"


@query("preprocess_corpus", f"""
WITH {_RESOLVED4}, {q.SPLIT} SELECT row_id, text, CAST(label AS INTEGER) AS label, split FROM sp""")
def preprocess_corpus(t: Tables):
    return preprocess.prepare(t.annotated(4))


@query("stage_counts", f"""
WITH {q.annotated(4)}, cln AS (SELECT {q.clean('text')} AS text, CASE WHEN row_id % 13 > 0 THEN label END AS label FROM ann),
g AS (SELECT text, count(*) AS n, min(label) AS lo, max(label) AS hi FROM cln GROUP BY text),
s AS (SELECT sum(n) AS a, sum(n) FILTER (text <> '') AS b, sum(n) FILTER (text <> '' AND lo IS NOT NULL) AS c,
      sum(n) FILTER (text <> '' AND lo = hi) AS d, count(*) FILTER (text <> '' AND lo = hi) AS e,
      count(*) FILTER (text <> '' AND lo = hi AND lo IN (-1, 0, 1)) AS f FROM g),
l AS (SELECT * FROM s, LATERAL (VALUES (0, 'raw', a, a), (1, 'not_blank', b, a), (2, 'labelled', c, b),
      (3, 'without_conflicts', d, c), (4, 'deduplicated', e, d), (5, 'mapped', f, e)) v(position, stage, x, y))
SELECT CAST(position AS INTEGER) AS position, stage, CAST(x AS BIGINT) AS n_rows, CAST(y - x AS BIGINT) AS n_lost FROM l""")
def stage_counts(t: Tables):
    rows = t.annotated(4).withColumn("label", F.when(F.col("row_id") % 13 > 0, F.col("label")))
    return preprocess.stage_counts(rows)


@query("stratified_split", f"WITH {q.PREPARED} SELECT row_id, CAST(label AS INTEGER) AS label, split FROM sp")
def stratified_split(t: Tables):
    return preprocess.prepare(t.labelled()).select("row_id", "label", "split")


@query("split_balance", f"""
WITH {q.PREPARED} SELECT split, CAST(label AS INTEGER) AS label, count(*) AS n,
  round(count(*) * 100.0 / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE), 4) AS pct
FROM sp GROUP BY split, label""")
def split_balance(t: Tables):
    return split.split_balance(preprocess.prepare(t.labelled()))


@query("cv_folds", f"""
WITH {q.PREPARED}, tr AS (SELECT row_id, label, row_number() OVER (PARTITION BY label
  ORDER BY md5(concat('42|', text)), row_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n
  FROM sp WHERE split = 'train')
SELECT row_id, CAST(label AS INTEGER) AS label, CAST(floor(r * 5 / CAST(n AS DOUBLE)) AS INTEGER) AS fold FROM tr""")
def cv_folds(t: Tables):
    train = preprocess.prepare(t.labelled()).where("split = 'train'").drop("split")
    return split.stratified_folds(train).select("row_id", "label", "fold")


@query("split_leakage", f"""
WITH {_RESOLVED4}, {q.SPLIT},
raw AS (SELECT row_id, text, CASE WHEN row_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM ann),
both_ AS (SELECT 'before' AS stage, text, split FROM raw UNION ALL SELECT 'after', text, split FROM sp),
f AS (SELECT stage, text, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM both_ GROUP BY stage, text)
SELECT stage, count(*) FILTER (tr) AS train_texts, count(*) FILTER (te) AS test_texts,
       count(*) FILTER (tr AND te) AS shared_texts FROM f GROUP BY stage""")
def split_leakage(t: Tables):
    naive = t.texts().withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    before = split.split_leakage(naive).withColumn("stage", F.lit("before"))
    after = split.split_leakage(preprocess.prepare(t.annotated(4))).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


# Scalars.

@query("tokens", f"""
SELECT doc_id AS row_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {q.TOKENS} AS t FROM documents)""")
def tokens(t: Tables):
    toks = t.texts().withColumn("t", tx.tokens(F.col("text")))
    return toks.select("row_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("ngrams", f"""
SELECT doc_id AS row_id, len(g) AS n_terms, len(list_distinct(g)) AS n_distinct, md5(array_to_string(g, '|')) AS digest
FROM (SELECT doc_id, {q.GRAMS} AS g FROM (SELECT doc_id, {q.TOKENS} AS t FROM documents))""")
def ngrams(t: Tables):
    terms = (t.texts().withColumn("t", tx.tokens(F.col("text"))).withColumn("g", tx.ngrams(F.col("t"))))
    return terms.select("row_id", F.size("g").cast("long").alias("n_terms"),
                        F.size(F.array_distinct("g")).cast("long").alias("n_distinct"),
                        F.md5(F.array_join("g", "|")).alias("digest"))


@query("ngrams_wide", f"""
SELECT doc_id AS row_id, len(g) AS n_terms, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, list_concat(t,
  list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
  list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g
  FROM (SELECT doc_id, {q.TOKENS} AS t FROM documents))""")
def ngrams_wide(t: Tables):
    terms = tfidf.with_terms(t.texts(), "g", tfidf.Vectorizer(ngram_range=(1, 3)))
    return terms.select("row_id", F.size("g").cast("long").alias("n_terms"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("preview_text", r"""
SELECT doc_id AS row_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '…') ELSE text END AS shortened,
       replace(substr(text, 1, 60), chr(10), ' ') AS snippet FROM documents""")
def preview_text(t: Tables):
    return t.texts().select("row_id", tx.shorten(F.col("text")).alias("shortened"),
                            tx.snippet(F.col("text")).alias("snippet"))


@query("tokenizer_compare", rf"""
SELECT doc_id AS row_id, CAST(len(a) AS INTEGER) AS script_tokens, CAST(len(b) AS INTEGER) AS plain_tokens,
       CAST(len(list_distinct(a)) AS INTEGER) AS script_distinct, CAST(len(list_distinct(b)) AS INTEGER) AS plain_distinct
FROM (SELECT doc_id, {q.TOKENS} AS a, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS b FROM documents)""")
def tokenizer_compare(t: Tables):

    return tfidf.compare_tokenizers(t.texts())
