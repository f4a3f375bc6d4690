"""Common table expressions shared by the check SQL (DuckDB dialect)."""

LABELLED = """lab AS (
  SELECT d.doc_id AS row_id, d.text, d.n_chars,
         CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def annotated(modulus: int = 3) -> str:
    return f"ann AS (SELECT doc_id AS row_id, text, CAST(doc_id % {modulus} AS INTEGER) - 1 AS label FROM documents)"


WITH_URLS = """urls AS (
  SELECT d.doc_id AS row_id, concat_ws(' ', d.text, p.url) AS text
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def clean(e: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({e}, ''),"
            r" 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g'), '@[\p{L}\p{N}_]+', '', 'g'),"
            r" '#([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g'))")


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_\x{0900}-\x{097F}]+')"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"


def resolved(source: str) -> str:
    """Cleaned, deduplicated and label-mapped rows of ``source``."""
    return f"""cln AS (SELECT * FROM (SELECT row_id, {clean('text')} AS text, label FROM {source}) WHERE text <> ''),
u AS (SELECT min(row_id) AS row_id, text, min(label) + 1 AS label FROM cln
      GROUP BY text HAVING min(label) = max(label) AND min(label) IN (-1, 0, 1))"""


SPLIT = """cnt AS (SELECT label, count(*) AS c FROM u GROUP BY label),
tot AS (SELECT sum(c) AS n, ceil(sum(c) * 0.2) AS nt FROM cnt),
q0 AS (SELECT label, c, nt, c * nt / CAST(n AS DOUBLE) AS ideal FROM cnt, tot),
q AS (SELECT label, c, floor(ideal) + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, label)
             <= nt - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END AS k FROM q0),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', text)), row_id) AS r FROM u),
sp AS (SELECT rk.row_id, rk.text, rk.label, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split
       FROM rk JOIN q ON rk.label = q.label)"""

PREPARED = f"{LABELLED}, {resolved('lab')}, {SPLIT}"

COUNTS = f"""tk AS (SELECT row_id, label, split, {TOKENS} AS t FROM sp),
g AS (SELECT row_id, label, split, unnest({GRAMS}) AS term FROM tk),
tc AS (SELECT row_id, label, split, term, count(*) AS tf FROM g GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
st AS (SELECT term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM tc WHERE split = 'train' GROUP BY term)"""


def vocabulary(name: str = "voc", size: int = 10000, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, ctf, df,
         ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT st.*, n FROM st, nd WHERE {where} ORDER BY ctf DESC, term LIMIT {size}))"""


TFIDF = f"""{PREPARED}, {COUNTS}, {vocabulary()},
w AS (SELECT row_id, label, split, tc.term, idx, (1 + ln(tf)) * idf AS w FROM tc JOIN voc ON tc.term = voc.term),
x AS (SELECT row_id, label, split, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM w)"""

CHI2 = f"""{TFIDF},
pr AS (SELECT label, count(*) / CAST((SELECT n FROM nd) AS DOUBLE) AS p FROM sp WHERE split = 'train' GROUP BY label),
fc AS (SELECT term, idx, sum(weight) AS f FROM x WHERE split = 'train' GROUP BY term, idx),
oc AS (SELECT term, label, sum(weight) AS o FROM x WHERE split = 'train' GROUP BY term, label),
ch AS (SELECT fc.term, fc.idx, round(sum((coalesce(o, 0) - p * f) * (coalesce(o, 0) - p * f) / (p * f)), 6) AS score
       FROM fc CROSS JOIN pr LEFT JOIN oc ON oc.term = fc.term AND oc.label = pr.label GROUP BY fc.term, fc.idx)"""

# Stand-in predictions.
PREDICTIONS = f"""{LABELLED},
y AS (SELECT row_id, text, n_chars, label + 1 AS label FROM lab),
pa AS (SELECT row_id, n_chars, label, CASE WHEN n_chars % 5 = 0 THEN (label + 1) % 3 ELSE label END AS pred FROM y),
pb AS (SELECT row_id, n_chars, label, CASE WHEN n_chars % 3 = 0 THEN (label + 2) % 3 ELSE label END AS pred FROM y),
pc AS (SELECT row_id, n_chars, label, CASE WHEN n_chars % 7 = 0 THEN (label + 1) % 3 ELSE label END AS pred FROM y),
p3 AS (SELECT 'a' AS model, * FROM pa UNION ALL SELECT 'b', * FROM pb UNION ALL SELECT 'c', * FROM pc)"""

METRICS = f"""{PREDICTIONS},
dim AS (SELECT CAST(l AS INTEGER) AS label FROM range(3) t(l)),
mods AS (SELECT DISTINCT model FROM p3),
cm AS (SELECT m.model, a.label, b.label AS pred, count(p3.row_id) AS n
       FROM mods m CROSS JOIN dim a CROSS JOIN dim b
       LEFT JOIN p3 ON p3.model = m.model AND p3.label = a.label AND p3.pred = b.label GROUP BY ALL),
pcl AS (SELECT model, label, tp, act AS support, coalesce(tp / nullif(prd, 0), 0) AS precision,
               coalesce(tp / nullif(act, 0), 0) AS recall, coalesce(2 * tp / nullif(prd + act, 0), 0) AS f1
        FROM (SELECT m.model, d.label,
                     CAST(sum(CASE WHEN cm.label = d.label AND cm.pred = d.label THEN n ELSE 0 END) AS DOUBLE) AS tp,
                     CAST(sum(CASE WHEN cm.pred = d.label THEN n ELSE 0 END) AS DOUBLE) AS prd,
                     CAST(sum(CASE WHEN cm.label = d.label THEN n ELSE 0 END) AS DOUBLE) AS act
              FROM mods m CROSS JOIN dim d JOIN cm ON cm.model = m.model GROUP BY m.model, d.label)),
ov AS (SELECT model, sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision,
              avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
              sum(precision * support) / sum(support) AS weighted_precision,
              sum(recall * support) / sum(support) AS weighted_recall, CAST(sum(support) AS BIGINT) AS n_rows
       FROM pcl GROUP BY model)"""

NAME = "CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END"

FLAT = METRICS + ",\nflat AS (SELECT ov.model, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, " + ", ".join(
    f"max(CASE WHEN label = {i} THEN {m} END) AS {m}_{n}"
    for m in ("precision", "recall", "f1") for i, n in enumerate(("Negative", "Neutral", "Positive"))
) + ", " + ", ".join(
    f"CAST(max(CASE WHEN label = {i} THEN support END) AS BIGINT) AS support_{n}"
    for i, n in enumerate(("Negative", "Neutral", "Positive"))
) + " FROM ov JOIN pcl ON ov.model = pcl.model GROUP BY ALL)"

LENGTHS = f"""len AS (SELECT 'chars' AS unit, length(text) AS length FROM documents
        UNION ALL SELECT 'words', len({WORDS}) FROM documents)"""

TRAINING_LOG = """lg AS (
  SELECT event_id - event_id % 2000 AS run_id, event_id % 2000 AS step, (event_id % 2000) / 200.0 AS epoch,
         CASE WHEN event_id % 200 <> 199 THEN value END AS loss,
         CASE WHEN event_id % 200 = 199 THEN value END AS eval_loss FROM events)"""
