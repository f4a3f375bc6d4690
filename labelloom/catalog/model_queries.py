"""Queries over features, models, metrics and comparisons."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from labelloom import settings
from labelloom.catalog import sqltext as q
from labelloom.catalog.registry import query
from labelloom.catalog.tables import Tables
from labelloom.functions import arrays as ar
from labelloom.functions import chars
from labelloom.functions import text as tx
from labelloom.operators import compare, heavy, linear, metrics, neural, selection, split, tfidf
from labelloom.plans import ablation, experiment, preprocess
from labelloom.session import materialise, shared_dir
from labelloom.streaming.score import score_stream

GUARDS = ["the", "not", settings.GUARD_TERM]


def _halves(t: Tables):
    """Train and test rows of the annotated documents, stored once."""
    return experiment.halves(preprocess.prepare(t.labelled()))


def _scorer(t: Tables):
    train, test = _halves(t)
    return experiment.fit_scorer(train), train, test


# TF-IDF.

@query("term_stats", f"WITH {q.PREPARED}, {q.COUNTS} SELECT term, ctf, df FROM st")
def term_stats(t: Tables):
    train, _ = _halves(t)
    return tfidf.term_stats(train)


@query("vocabulary", f"WITH {q.PREPARED}, {q.COUNTS}, {q.vocabulary()} SELECT term, idx, ctf, df FROM voc")
def vocabulary(t: Tables):
    train, _ = _halves(t)
    stats = materialise(tfidf.term_stats(train))
    return tfidf.vocabulary(stats, train.count()).select("term", "idx", "ctf", "df")


@query("vocabulary_summary", f"WITH {q.PREPARED}, {q.COUNTS}, {q.vocabulary(size=1000)} SELECT term, idx, ctf, df FROM voc")
def vocabulary_summary(t: Tables):
    """The 1,000 most frequent terms by sketches and a second, exact pass."""
    return heavy.fit(_halves(t)[0], 1000).vocab.select("term", "idx", "ctf", "df")


@query("tfidf_fit", f"""
WITH {q.PREPARED}, {q.COUNTS}, {q.vocabulary()}
SELECT term, idx, ctf, df, round(idf, 6) AS idf, (SELECT n FROM nd) AS n_docs FROM voc""")
def tfidf_fit(t: Tables):
    train, _ = _halves(t)
    return tfidf.fit(train).vocab.withColumn("idf", F.round("idf", 6))


@query("tfidf_transform", f"WITH {q.TFIDF} SELECT row_id, split, idx, round(weight, 6) AS weight FROM x")
def tfidf_transform(t: Tables):
    rows = preprocess.prepare(t.labelled())
    model = tfidf.fit(experiment.halves(rows)[0])
    return tfidf.long_weights(rows, model, ["split"]).withColumn("weight", F.round("weight", 6))


@query("tfidf_join", f"WITH {q.TFIDF} SELECT row_id, term, idx, round(weight, 6) AS weight FROM x")
def tfidf_join(t: Tables):
    rows = preprocess.prepare(t.labelled())
    return tfidf.weights_by_join(rows, tfidf.fit(experiment.halves(rows)[0])).withColumn("weight", F.round("weight", 6))


_TRIGRAMS = q.COUNTS.replace(q.GRAMS, """list_concat(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
  list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))""").replace(
    q.TOKENS, r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')")


@query("tfidf_options", f"""
WITH {q.PREPARED}, {_TRIGRAMS}, {q.vocabulary(size=3000)},
w AS (SELECT row_id, tc.term, idx, tf * idf AS w FROM tc JOIN voc ON tc.term = voc.term)
SELECT row_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w""")
def tfidf_options(t: Tables):
    """Runs of two and three plain words, raw counts, 3,000 terms."""
    rows = preprocess.prepare(t.labelled())
    how = tfidf.Vectorizer((2, 3), chars.PLAIN_TOKEN, sublinear_tf=False)
    model = tfidf.fit(experiment.halves(rows)[0], 3000, how=how)
    return tfidf.long_weights(rows, model).withColumn("weight", F.round("weight", 6))


@query("tfidf_density", f"""
WITH {q.TFIDF} SELECT (SELECT n FROM nd) AS n_rows, (SELECT count(*) FROM voc) AS vocab_size, count(*) AS nnz,
  round(count(*) * 100.0 / CAST((SELECT n FROM nd) * (SELECT count(*) FROM voc) AS DOUBLE), 6) AS density_pct
FROM x WHERE split = 'train'""")
def tfidf_density(t: Tables):
    train, _ = _halves(t)
    return tfidf.density(train, tfidf.fit(train))


@query("vocab_sample", f"""
WITH {q.PREPARED}, {q.COUNTS}, {q.vocabulary()}
SELECT idx, term FROM voc ORDER BY md5(concat('42|', term)), term LIMIT 15""")
def vocab_sample(t: Tables):
    train, _ = _halves(t)
    return tfidf.vocab_sample(tfidf.fit(train).vocab)


@query("chi2_scores", f"WITH {q.CHI2} SELECT term, idx, score FROM ch")
def chi2_scores(t: Tables):
    train, _ = _halves(t)
    return selection.chi2_scores(train, tfidf.fit(train))


@query("chi2_select", f"WITH {q.CHI2} SELECT term, idx, score FROM ch ORDER BY score DESC, term DESC LIMIT 5000")
def chi2_select(t: Tables):
    train, _ = _halves(t)
    return selection.chi2_select(selection.chi2_scores(train, tfidf.fit(train)))


_VARIANTS = f"""{q.CHI2}, {q.vocabulary('v2', where='df <= 0.9 * n')}, {q.vocabulary('v3', where='df <= 0.9 * n AND df >= 2')},
v4 AS (SELECT term FROM ch ORDER BY score DESC, term DESC LIMIT 5000),
va AS (SELECT 'baseline' AS variant, term FROM voc UNION ALL SELECT 'max_df', term FROM v2
       UNION ALL SELECT 'max_df_min_df', term FROM v3 UNION ALL SELECT 'chi2', term FROM v4)"""


@query("ablation_vocab", f"""
WITH {_VARIANTS} SELECT variant, count(*) AS vocab_size, bool_or(term = 'the') AS has_guard FROM va GROUP BY variant""")
def ablation_vocab(t: Tables):
    train, _ = _halves(t)
    return ablation.vocab_table(ablation.fit_variants(train), guard="the")


@query("guard_terms", f"""
WITH {_VARIANTS} SELECT variant, g.term, bool_or(va.term = g.term) AS kept
FROM va CROSS JOIN (VALUES ('the'), ('not'), ('छैन')) g(term) GROUP BY variant, g.term""")
def guard_terms(t: Tables):
    train, _ = _halves(t)
    return selection.guard_terms(ablation.variant_terms(ablation.fit_variants(train)), GUARDS)


# Linear model.

@query("class_weights", f"""
WITH {q.PREPARED} SELECT CAST(label AS INTEGER) AS label, count(*) AS n,
  round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight
FROM sp WHERE split = 'train' GROUP BY label""")
def class_weights(t: Tables):
    train, _ = _halves(t)
    return linear.class_weights(train)


@query("lr_fit")
def lr_fit(t: Tables):
    scorer, _, _ = _scorer(t)
    return linear.coefficients(t.spark, scorer.model).join(
        scorer.features.vocab.select("idx", "term"), "idx", "left")


@query("lr_mass", f"""
WITH {q.PREPARED} SELECT CAST(label AS INTEGER) AS label, (SELECT count(*) FROM sp WHERE split = 'train') AS n,
  round(1 / CAST(3 AS DOUBLE), 2) AS mass FROM sp WHERE split = 'train' GROUP BY label""")
def lr_mass(t: Tables):
    """Share of the weighted rows that the fitted model gives each class on its training rows.

    With an unpenalised intercept and balanced weights every class must get the same share.
    """
    scorer, train, _ = _scorer(t)
    weights = linear.class_weights(train).select(F.col("label").alias("l"), "weight")
    scored = scorer.predict(train).join(F.broadcast(weights), F.col("label") == F.col("l"))  # one row per class
    sums = [F.sum(F.col("weight") * F.col("probabilities")[c]) for c in range(settings.NUM_CLASSES)]
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("m"))
    return row.select(F.posexplode("m").alias("label", "mass"), "n").select("label", "n", F.round(F.col("mass") / F.col("n"), 2).alias("mass"))


@query("lr_predict")
def lr_predict(t: Tables):
    scorer, _, test = _scorer(t)
    return scorer.predict(test).select("row_id", "label", "pred", "confidence", "probabilities")


@query("cv_table")
def cv_table(t: Tables):
    train, _ = _halves(t)
    _, result = experiment.tune_scorer(train)
    return result.table


@query("ablation")
def ablation_scores(t: Tables):
    train, test = _halves(t)
    return ablation.run(train, test, ablation.fit_variants(train), guard="the")


@query("flagship")
def flagship(t: Tables):
    return experiment.test_metrics(preprocess.prepare(t.labelled()))


_SUPPORT = f"""
WITH {q.PREPARED} SELECT CAST(label AS INTEGER) AS label, {q.NAME} AS label_name, count(*) AS support
FROM sp WHERE split = 'test' GROUP BY label"""


@query("flagship_support", _SUPPORT)
def flagship_support(t: Tables):
    """The test rows the flagship's metrics stand on."""
    return flagship(t).select("label", "label_name", "support")


@query("sample_predictions", f"""
WITH {q.PREDICTIONS}, r AS (SELECT y.row_id, text, y.label, pa.pred, y.n_chars,
  row_number() OVER (PARTITION BY y.label ORDER BY y.row_id) AS position FROM y JOIN pa ON pa.row_id = y.row_id)
SELECT row_id, CAST(position AS INTEGER) AS position,
  CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '…') ELSE text END AS text, {q.NAME} AS true_label,
  {q.NAME.replace('label', 'pred')} AS predicted, pred = label AS correct,
  round(1 / (1 + n_chars % 7 / CAST(10 AS DOUBLE)), 4) AS confidence FROM r WHERE position <= 3""")
def sample_predictions(t: Tables):
    made = t.predictions("a").select("row_id", "pred", (1 / (1 + F.col("n_chars") % 7 / F.lit(10.0))).alias("confidence"))
    return experiment.sample_predictions(t.truth().select("row_id", "text", "label").join(made, "row_id"))


_COVERED = """SELECT conv_id, turn, count(*) AS n, CAST(1 AS DOUBLE) AS total FROM conversations GROUP BY conv_id, turn"""


def _covered(scored):
    total = sum((F.col(f"prob_{n}") for n in settings.LABEL_NAMES), F.lit(0.0))
    return scored.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(total), 6).alias("total"))


@query("score_coverage", _COVERED)
def score_coverage(t: Tables):
    """Every conversation turn is scored once, with probabilities that add up to one."""
    return _covered(score_new_text(t))


@query("stream_coverage", _COVERED)
def stream_coverage(t: Tables):
    return _covered(stream_score(t))


@query("score_new_text")
def score_new_text(t: Tables):
    """Scores every conversation turn with a model trained on the annotated documents."""
    scorer, _, _ = _scorer(t)
    return scorer.score(t.table("conversations").select("conv_id", "turn", "text")).drop("text")


@query("stream_score")
def stream_score(t: Tables):
    """The same scoring over the conversations table, a file or a folder of files, as a file stream into a Parquet sink."""
    scorer, _, _ = _scorer(t)
    base = f"{shared_dir(t.spark)}/stream-score-{uuid.uuid4().hex}"
    # a pattern, since as a plain path the stream takes a folder of files alone
    stream = score_stream(t.spark, t.path("{conversations}"), t.table("conversations").schema, scorer, f"{base}/rows",
                          f"{base}/progress", keep=["conv_id", "turn"])
    stream.awaitTermination()
    return t.spark.read.parquet(f"{base}/rows").drop("text")


@query("run_cost")
def run_cost(t: Tables):
    """Time per row of scoring the test split, vectorisation included."""
    scorer, _, test = _scorer(t)
    cost = compare.run_cost("linear", lambda: scorer.predict(test))
    return t.spark.createDataFrame([cost], "model string, rows bigint, elapsed_s double, ms_per_sample double")


@query("run_cost_rows", f"WITH {q.PREPARED} SELECT 'linear' AS model, count(*) AS rows FROM sp WHERE split = 'test'")
def run_cost_rows(t: Tables):
    return run_cost(t).select("model", "rows")


# Neural scoring.

_CENTROIDS = """ex AS (SELECT vec_id, label, CAST(i AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS e
       FROM embeddings, range(1, 65) r(i)),
ce AS (SELECT label, i, avg(e) AS m FROM ex GROUP BY label, i),
lo AS (SELECT ex.vec_id, ex.label AS truth, ce.label AS k, sum(e * m) - 0.5 * sum(m * m) AS z
       FROM ex JOIN ce ON ce.i = ex.i GROUP BY ALL),
ra AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS r,
              max(z) OVER (PARTITION BY vec_id) AS mx FROM lo)"""


_BATCH_SCORE = f"""
WITH {_CENTROIDS} SELECT vec_id, CAST(max(CASE WHEN r = 1 THEN k END) AS INTEGER) AS pred,
  round(1 / sum(exp(z - mx)), 6) AS confidence FROM ra GROUP BY vec_id"""


def _batch_scored(vectors, head):
    scored = neural.batch_score(vectors, head, "embedding", 64)
    return scored.select("vec_id", "pred", F.round("confidence", 6).alias("confidence"))


@query("batch_score", _BATCH_SCORE)
def batch_score(t: Tables):
    vectors = t.table("embeddings")
    return _batch_scored(vectors, neural.linear_head(*neural.centroid_head(vectors, "embedding", "label", 64)))


@query("batch_score_file", _BATCH_SCORE)
def batch_score_file(t: Tables):
    """The same head, stored as a model file that the executors load."""
    vectors = t.table("embeddings")
    path = f"{shared_dir(t.spark)}/head-{uuid.uuid4().hex}.npz"
    neural.save_head(t.spark, path, *neural.centroid_head(vectors, "embedding", "label", 64))
    return _batch_scored(vectors, neural.model_file(t.spark, path))


def _dense(t: Tables):
    train, test = _halves(t)
    parts = split.stratified_split(train, share=0.2, seed=7)
    fit_rows, valid = experiment.halves(parts)
    return neural.fit_dense(fit_rows, valid), train, test


@query("dense_classifier")
def dense_classifier(t: Tables):
    """Per-class metrics of the dense classifier; its training length is chosen on a validation
    part taken from the training split."""
    model, _, test = _dense(t)
    return metrics.metrics_per_class(metrics.confusion_record(neural.predict_dense(test, model)))


@query("dense_support", _SUPPORT)
def dense_support(t: Tables):
    return dense_classifier(t).select("label", "label_name", "support")


@query("fitted_comparison")
def fitted_comparison(t: Tables):
    """The linear and the dense classifier on one test split, with measured scoring costs."""
    dense, train, test = _dense(t)
    linear_model = experiment.fit_scorer(train)
    runs = {"linear": lambda: linear_model.predict(test), "dense": lambda: neural.predict_dense(test, dense)}
    costs = {name: compare.run_cost(name, run) for name, run in runs.items()}
    return experiment.compare_fitted({name: run() for name, run in runs.items()}, costs)


_LOGITS = """l AS (SELECT vec_id, i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i))"""


def _logits(t: Tables):
    return t.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))


@query("softmax", f"""
WITH {_LOGITS}, m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM l)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM m""")
def softmax(t: Tables):
    p = _logits(t).select("vec_id", F.posexplode(ar.softmax(F.col("l"))).alias("k", "p"))
    return p.select("vec_id", "k", F.round("p", 6).alias("p"))


@query("argmax_class", f"""
WITH {_LOGITS} SELECT vec_id, CAST(k AS INTEGER) AS pred FROM l
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) = 1""")
def argmax_class(t: Tables):
    return _logits(t).select("vec_id", ar.argmax(F.col("l")).alias("pred"))


@query("pad_mask", f"""
WITH s AS (SELECT doc_id, list_transform({q.WORDS}, lambda w: length(w)) AS ids FROM documents)
SELECT doc_id AS row_id,
  array_to_string(list_transform(range(1, 65), lambda i: coalesce(ids[i], 0)), ',') AS input_ids,
  array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask
FROM s""")
def pad_mask(t: Tables):

    ids = t.texts().select("row_id", F.transform(tx.words(F.col("text")), lambda w: F.length(w)).alias("ids"))
    n = settings.MAX_LENGTH
    return ids.select("row_id",
                      F.array_join(ar.pad(F.col("ids"), n).cast("array<string>"), ",").alias("input_ids"),
                      F.array_join(ar.attention_mask(F.col("ids"), n).cast("array<string>"), ",").alias("attention_mask"))


# Metrics.

@query("metrics_all_rows", f"""
WITH {q.LABELLED}, y AS (SELECT row_id % 10 AS label, CASE WHEN n_chars % 6 = 0 THEN NULL WHEN n_chars % 6 = 1 THEN 77
       WHEN n_chars % 6 = 2 THEN (row_id + 1) % 10 ELSE row_id % 10 END AS pred FROM lab),
c AS (SELECT r AS label FROM range(10) t(r)),
s AS (SELECT c.label, count(*) FILTER (y.label = c.label) AS act, count(*) FILTER (y.pred = c.label) AS prd,
      count(*) FILTER (y.label = c.label AND y.pred = c.label) AS tp FROM c, y GROUP BY c.label),
p AS (SELECT coalesce(tp / nullif(CAST(prd AS DOUBLE), 0), 0) AS pr, coalesce(tp / nullif(CAST(act AS DOUBLE), 0), 0) AS re,
      coalesce(2 * tp / nullif(CAST(prd + act AS DOUBLE), 0), 0) AS f, act, tp FROM s)
SELECT round(sum(tp) / CAST((SELECT count(*) FROM y) AS DOUBLE), 6) AS accuracy, round(avg(pr), 6) AS macro_precision,
  round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(f * act) / CAST(sum(act) AS DOUBLE), 6) AS weighted_f1 FROM p""")
def metrics_all_rows(t: Tables):
    """Ten classes, with missing predictions and predictions that are no class."""
    m, label = F.col("n_chars") % 6, F.col("row_id") % 10
    rows = t.labelled("n_chars").select(label.alias("label"), F.when(m == 0, None).when(m == 1, 77).when(
        m == 2, (F.col("row_id") + 1) % 10).otherwise(label).alias("pred"))
    return metrics.metrics_overall(metrics.confusion_record(rows, classes=10))


@query("confusion_matrix", f"""
WITH {q.METRICS} SELECT model, label, pred, n FROM cm""")
def confusion_matrix(t: Tables):
    return metrics.confusion_matrix(metrics.confusion_record(t.by_model("a", "b", "c"), ["model"]), ["model"])


@query("confusion_matrix_norm", f"""
WITH {q.METRICS} SELECT model, label, pred,
  round(coalesce(n / nullif(CAST(sum(n) OVER (PARTITION BY model, label) AS DOUBLE), 0), 0), 6) AS share FROM cm""")
def confusion_matrix_norm(t: Tables):
    return metrics.confusion_matrix_norm(metrics.confusion_record(t.by_model("a", "b", "c"), ["model"]), ["model"])


@query("metrics_overall", f"WITH {q.METRICS} SELECT model, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in metrics.HEADLINE) + " FROM ov")
def metrics_overall(t: Tables):
    return metrics.metrics_overall(metrics.confusion_record(t.by_model("a", "b", "c"), ["model"]), ["model"])


@query("metrics_per_class", f"""
WITH {q.METRICS} SELECT model, label, {q.NAME} AS label_name, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pcl""")
def metrics_per_class(t: Tables):
    return metrics.metrics_per_class(metrics.confusion_record(t.by_model("a", "b", "c"), ["model"]), ["model"])


@query("classification_report", f"""
WITH {q.METRICS}
SELECT model, label AS position, {q.NAME} AS "row", round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM pcl
UNION ALL SELECT model, 3, 'accuracy', round(accuracy, 4), round(accuracy, 4), round(accuracy, 4), n_rows FROM ov
UNION ALL SELECT model, 4, 'macro avg', round(macro_precision, 4), round(macro_recall, 4), round(macro_f1, 4), n_rows FROM ov
UNION ALL SELECT model, 5, 'weighted avg', round(weighted_precision, 4), round(weighted_recall, 4),
       round(weighted_f1, 4), n_rows FROM ov""")
def classification_report(t: Tables):
    return metrics.classification_report(metrics.confusion_record(t.by_model("a", "b", "c"), ["model"]), ["model"])


_FLAT_COLUMNS = metrics.HEADLINE + [f"{m}_{c}" for m in ("precision", "recall", "f1") for c in settings.LABEL_NAMES]
_SUPPORTS = [f"support_{c}" for c in settings.LABEL_NAMES]


def _flat(t: Tables, *models: str, decimals: int | None = 6):
    return metrics.flat_metrics(metrics.confusion_record(t.by_model(*models), ["model"]), ["model"], decimals)


@query("flat_metrics", f"WITH {q.FLAT} SELECT model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _FLAT_COLUMNS) + ", " + ", ".join(_SUPPORTS) + " FROM flat")
def flat_metrics(t: Tables):
    return _flat(t, "a", "b", "c")


# Comparison.

@query("join_predictions", f"""
WITH {q.PREDICTIONS} SELECT y.row_id, CAST(y.label AS INTEGER) AS label, CAST(pa.pred AS INTEGER) AS pred_a,
  CAST(pb.pred AS INTEGER) AS pred_b FROM y JOIN pa ON pa.row_id = y.row_id JOIN pb ON pb.row_id = y.row_id""")
def join_predictions(t: Tables):
    return compare.join_predictions(t.truth().select("row_id", "label"), t.predictions("a"), t.predictions("b"))


@query("model_agreement", f"""
WITH {q.PREDICTIONS}, j AS (SELECT y.label, pa.pred AS a, pb.pred AS b
  FROM y JOIN pa ON pa.row_id = y.row_id JOIN pb ON pb.row_id = y.row_id)
SELECT count(*) AS n_rows, count(*) FILTER (a = label) AS a_correct, count(*) FILTER (b = label) AS b_correct,
  count(*) FILTER (a = b) AS agree, count(*) FILTER (a = label AND b = label) AS both_correct,
  count(*) FILTER (a <> label AND b <> label) AS both_wrong,
  round(count(*) FILTER (a = b) / CAST(count(*) AS DOUBLE), 6) AS agreement FROM j""")
def model_agreement(t: Tables):
    return compare.model_agreement(join_predictions(t))


def _named(col: str, out: str) -> str:
    return f"CASE {col} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS {out}"


@query("side_by_side", f"""
WITH {q.PREDICTIONS} SELECT y.row_id,
  CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '…') ELSE text END AS text,
  {_named('y.label', 'true_label')}, {_named('pa.pred', 'label_a')}, {_named('pb.pred', 'label_b')},
  pa.pred = y.label AS a_correct, pb.pred = y.label AS b_correct
FROM y JOIN pa ON pa.row_id = y.row_id JOIN pb ON pb.row_id = y.row_id""")
def side_by_side(t: Tables):
    truth = t.truth().select("row_id", "text", "label")
    return compare.side_by_side(compare.join_predictions(truth, t.predictions("a"), t.predictions("b")))


@query("results_union", f"WITH {q.FLAT} SELECT model, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _FLAT_COLUMNS) + ", " + ", ".join(_SUPPORTS) + " FROM flat WHERE model IN ('a', 'b')")
def results_union(t: Tables):
    return compare.results_union(_flat(t, "a"), _flat(t, "b"))


_COST = """cost AS (SELECT model, avg(n_chars) / 1000 * CASE model WHEN 'a' THEN 1 WHEN 'b' THEN 3 ELSE 2 END AS ms
  FROM p3 GROUP BY model)"""


def _with_cost(t: Tables, *models: str):
    """Flat rows plus a stand-in latency proportional to the mean text length."""
    factor = F.when(F.col("model") == "a", 1).when(F.col("model") == "b", 3).otherwise(2)
    rows = t.by_model(*models)
    cost = rows.groupBy("model").agg((F.avg("n_chars") / 1000).alias("ms")).select(
        "model", F.round(F.col("ms") * factor, 6).alias("inference_ms_per_sample"))
    return _flat(t, *models).join(cost, "model")


_METRIC_LIST = _FLAT_COLUMNS + _SUPPORTS


def _long_sql(models: str) -> str:
    parts = [f"SELECT model, {i} AS position, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM flat"
             for i, m in enumerate(_METRIC_LIST)]
    parts.append(f"SELECT model, {len(_METRIC_LIST)}, 'inference_ms_per_sample', round(ms, 6) FROM cost")
    return f"lg AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE model IN ({models}))"


@query("comparison", f"""
WITH {q.FLAT}, {_COST}, {_long_sql("'a', 'b'")}
SELECT CAST(position AS INTEGER) AS position, metric, a, b, CASE WHEN metric LIKE 'support%' THEN ''
  WHEN metric = 'inference_ms_per_sample' THEN CASE WHEN a <= b THEN 'a' ELSE 'b' END
  WHEN a >= b THEN 'a' ELSE 'b' END AS winner
FROM (SELECT position, metric, max(CASE WHEN model = 'a' THEN value END) AS a,
             max(CASE WHEN model = 'b' THEN value END) AS b FROM lg GROUP BY position, metric)""")
def comparison(t: Tables):
    return compare.comparison_table(_with_cost(t, "a", "b"), ["a", "b"], ["inference_ms_per_sample"])


@query("metric_winner", f"""
WITH {q.FLAT}, {_COST}, {_long_sql("'a', 'b', 'c'")},
r AS (SELECT metric, model, row_number() OVER (PARTITION BY metric ORDER BY
  CASE WHEN metric = 'inference_ms_per_sample' THEN value ELSE -value END, model) AS r FROM lg)
SELECT metric, CASE WHEN metric LIKE 'support%' THEN '' ELSE model END AS winner FROM r WHERE r = 1""")
def metric_winner(t: Tables):
    rows = compare.metric_rows(_with_cost(t, "a", "b", "c"), _METRIC_LIST + ["inference_ms_per_sample"])
    order = F.when(F.col("model") == "a", 0).when(F.col("model") == "b", 1).otherwise(2)
    return compare.metric_winner(rows.withColumn("model_order", order))


@query("ablation_decision", f"""
WITH {q.METRICS}, b AS (SELECT * FROM ov ORDER BY macro_f1 DESC, model LIMIT 1),
z AS (SELECT macro_f1 AS base FROM ov WHERE model = 'b')
SELECT model AS winner, round(macro_f1, 6) AS best_f1, round(base, 6) AS baseline_f1, round(macro_f1 - base, 6) AS delta,
       CASE WHEN macro_f1 - base > 0.001 THEN 'promote' ELSE 'keep' END AS decision FROM b, z""")
def ablation_decision(t: Tables):
    order = F.when(F.col("model") == "a", 0).when(F.col("model") == "b", 1).otherwise(2)
    rows = _flat(t, "a", "b", "c", decimals=None).select(
        F.col("model").alias("variant"), order.alias("position"), "macro_f1")
    return selection.decide(rows, baseline="b")


@query("latest_result", """
SELECT event_type AS model, ts AS run_ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_result(t: Tables):
    runs = t.table("events").select(F.col("event_type").alias("model"), F.col("ts").alias("run_ts"), "event_id", "value")
    return compare.latest_per_model(runs, tie="event_id")


@query("early_stop", f"""
WITH {q.TRAINING_LOG},
e AS (SELECT run_id, CAST(floor(epoch) AS BIGINT) + 1 AS epoch, eval_loss AS f1 FROM lg WHERE eval_loss IS NOT NULL),
g AS (SELECT *, max(f1) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
h AS (SELECT *, sum(CASE WHEN b IS NULL OR f1 > b THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch) AS grp FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY run_id, grp ORDER BY epoch) - 1 AS stale FROM h),
s AS (SELECT run_id, min(CASE WHEN stale >= 2 THEN epoch END) AS stop_epoch FROM i GROUP BY run_id),
k AS (SELECT e.*, stop_epoch, row_number() OVER (PARTITION BY e.run_id ORDER BY f1 DESC, epoch) AS r
      FROM e JOIN s ON s.run_id = e.run_id WHERE stop_epoch IS NULL OR epoch <= stop_epoch)
SELECT run_id, stop_epoch, epoch AS best_epoch, round(f1, 6) AS best_macro_f1 FROM k WHERE r = 1""")
def early_stop(t: Tables):
    log = t.training_log().where(F.col("macro_f1").isNotNull())
    return compare.early_stop(log.select("run_id", (F.floor("epoch") + 1).alias("epoch"), "macro_f1"))


@query("training_curve", f"""
WITH {q.TRAINING_LOG},
a AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY e) AS epoch, train_loss FROM
      (SELECT run_id, floor(epoch) + 1 AS e, avg(loss) AS train_loss FROM lg WHERE loss IS NOT NULL GROUP BY 1, 2)),
b AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) AS epoch, eval_loss FROM lg WHERE eval_loss IS NOT NULL)
SELECT a.run_id, CAST(a.epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss, round(eval_loss, 6) AS eval_loss
FROM a JOIN b ON a.run_id = b.run_id AND a.epoch = b.epoch""")
def training_curve(t: Tables):
    return compare.training_curve(t.training_log())
