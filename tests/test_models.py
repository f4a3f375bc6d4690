"""Linear model, metrics, comparison, neural scoring, streaming and storage."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.catalog import model_queries
from labelloom.catalog.tables import Tables
from labelloom.functions import arrays as ar
from labelloom.operators import batched, compare, linear, metrics, neural
from labelloom.plans import charts, experiment, preprocess
from labelloom.sources import artifacts, corpus as store, results
from labelloom.streaming.score import score_stream


def pairs(spark, truth, pred):
    return spark.createDataFrame(list(zip(truth, pred)), "label int, pred int")


# Metrics.

def test_metrics_known(spark):
    rec = metrics.confusion_record(pairs(spark, [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0]))
    cm = {(r.label, r.pred): r.n for r in metrics.confusion_matrix(rec).collect()}
    assert [[cm[t, p] for p in range(3)] for t in range(3)] == [[1, 1, 0], [0, 2, 0], [1, 0, 1]]
    o = metrics.metrics_overall(rec).first()
    assert o.accuracy == 0.666667 and o.macro_precision == 0.722222 and o.macro_f1 == 0.655556
    report = metrics.classification_report(rec).orderBy("position").collect()
    assert [r.row for r in report] == ["Negative", "Neutral", "Positive", "accuracy", "macro avg", "weighted avg"]
    assert report[3].support == 6


@pytest.mark.parametrize("pred,score", [([0, 1, 2], 1.0), ([1, 2, 0], 0.0)])
def test_metrics_extremes(spark, pred, score):
    o = metrics.metrics_overall(metrics.confusion_record(pairs(spark, [0, 1, 2], pred))).first()
    assert o.accuracy == o.macro_f1 == o.weighted_f1 == score


def test_every_labelled_row_counts(spark):
    rows = spark.createDataFrame([(0, 0), (1, None), (2, 7), (1, 1), (None, 1)], "label int, pred int")
    rec = metrics.confusion_record(rows)
    assert metrics.metrics_overall(rec).first().accuracy == 0.5
    assert {r.label: (r.support, r.recall) for r in metrics.metrics_per_class(rec).collect()} == {0: (1, 1.0), 1: (2, 0.5), 2: (1, 0.0)}


def test_class_never_predicted(spark):
    rec = metrics.confusion_record(pairs(spark, [0, 1, 2], [0, 0, 0]))
    rows = {r.label: r for r in metrics.metrics_per_class(rec).collect()}
    assert rows[1].precision == rows[2].precision == 0.0 and rows[0].recall == 1.0
    share = metrics.confusion_matrix_norm(metrics.confusion_record(pairs(spark, [0, 0], [0, 1]))).collect()
    assert sum(r.share for r in share) == 1.0  # classes without rows give zeros


def test_metrics_random(spark):
    rng = random.Random(2)
    truth = [rng.randrange(3) for _ in range(400)]
    pred = [t if rng.random() < 0.6 else rng.randrange(3) for t in truth]
    flat = metrics.flat_metrics(metrics.confusion_record(pairs(spark, truth, pred))).first()
    f1s = []
    for c, name in enumerate(["Negative", "Neutral", "Positive"]):
        tp = sum(t == p == c for t, p in zip(truth, pred))
        f1s.append(2 * tp / (truth.count(c) + pred.count(c)))
        assert abs(flat[f"f1_{name}"] - f1s[-1]) < 1e-12 and flat[f"support_{name}"] == truth.count(c)
    assert abs(flat.macro_f1 - sum(f1s) / 3) < 1e-12


# Linear model.

def features(spark, n=90, d=6, seed=0):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(3, d)) * 2
    rows = []
    for i in range(n):
        x = rng.normal(size=d) * (rng.random(d) < 0.6)
        y = int(np.argmax(w @ x + rng.gumbel(size=3) + np.array([1.0, 0, -1])))
        rows.append((i, y, i % 3, Vectors.sparse(d, [(j, float(v)) for j, v in enumerate(x) if v])))
    df = spark.createDataFrame(rows, ["row_id", "label", "fold", "features"])
    return rows, df.withColumn("label", F.col("label").cast("int")).withColumn("fold", F.col("fold").cast("int"))


def descend(rows, c, steps=60000):
    """Minimise c * sum(w_i * loss_i) + |B|^2 / 2 by plain gradient descent."""
    x = np.array([r[3].toArray() for r in rows])
    y = np.array([r[1] for r in rows])
    n, d = x.shape
    wts = np.array([n / (3 * (y == k).sum()) for k in y])
    target = np.eye(3)[y]
    b, b0 = np.zeros((3, d)), np.zeros(3)
    rate = 1.0 / (c * wts.sum() * (1 + (x ** 2).sum(1).max()) * 0.5 + 1)
    for _ in range(steps):
        z = x @ b.T + b0
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * wts[:, None] * c
        b, b0 = b - rate * (g.T @ x + b), b0 - rate * g.sum(0)
    return b, b0


def test_fit_matches_descent(spark):
    rows, df = features(spark)
    model = linear.fit(df, c=0.7, tol=1e-12)
    b, b0 = descend(rows, 0.7)
    assert np.abs(model.coefficientMatrix.toArray() - b).max() < 1e-4
    got = model.interceptVector.toArray()
    assert np.abs((got - got.mean()) - (b0 - b0.mean())).max() < 1e-4


def test_batched_fits_equal_separate_ones(spark, monkeypatch):
    rows, df = features(spark)
    monkeypatch.setattr(batched, "BLOCK_VALUES", 40)
    monkeypatch.setattr(batched, "DENSE_CELLS", 60)
    monkeypatch.setattr(batched, "TASK_BYTES", 300)
    monkeypatch.setattr(batched, "FAN_IN", 2)
    packed = batched.pack(df.select("label", "fold", "features").repartition(6))
    fits = [batched.Fit(f, c) for f in (0, 2, None) for c in (0.05, 0.7)]
    found, jobs = batched.solve(packed, fits, 3, df.first().features.size, 500, 1e-14)
    assert jobs < 400
    for f, got in zip(fits, found):
        part = df if f.fold is None else df.where(F.col("fold") != f.fold)
        model = linear.fit(part, f.c, tol=1e-14)
        want, free = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        assert np.abs((got[:, :-1] - got[:, :-1].mean(0)) - (want - want.mean(0))).max() < 1e-5
        assert np.abs((got[:, -1] - got[:, -1].mean()) - (free - free.mean())).max() < 1e-5


def test_tasks_read_more_than_the_gradients_they_return(spark, monkeypatch):
    rows, df = features(spark)
    monkeypatch.setattr(batched, "BLOCK_VALUES", 1)
    packed = batched.pack(df.select("label", "fold", "features")).repartition(30)
    size = batched.packed_bytes(packed)
    assert packed.rdd.getNumPartitions() > 16 and size > 0
    fits = [batched.Fit(f, c) for f in range(5) for c in (0.1, 1.0, 10.0)]
    problem = batched.Problem(packed, fits, 3, df.first().features.size)
    assert problem.blocks.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sum(len(label) for label, *_ in batched.blocks(problem.blocks.collect())) == len(rows)


def test_grid_search_is_the_same_batched_and_separate(spark):
    _, df = features(spark)
    both = [linear.grid_search(df, [0.01, 0.5, 5.0], evaluator=e, search_tol=1e-10) for e in (None, linear.MacroF1())]
    tables = [{r.c: (round(r.mean_macro_f1, 9), round(r.std_macro_f1, 9), r.folds, r.is_best) for r in b.table.collect()} for b in both]
    assert tables[0] == tables[1] and both[0].best_c == both[1].best_c


def test_batched_states_are_bounded(spark, monkeypatch):
    _, df = features(spark)
    monkeypatch.setattr(batched, "MAX_STATE_BYTES", 1000)
    with pytest.raises(ValueError, match="MAX_STATE_BYTES"):
        linear.grid_search(df, [1.0])


def test_grid_search_and_storage(spark, tmp_path):
    _, df = features(spark)
    result = linear.grid_search(df, [0.01, 1.0], parallelism=2)
    table = {r.c: r for r in result.table.collect()}
    assert set(table) == {0.01, 1.0} and all(r.folds == 3 for r in table.values())
    best = max(table.values(), key=lambda r: r.mean_macro_f1)
    assert table[result.best_c].is_best and best.c == result.best_c
    scored = linear.predict(df, result.model)
    assert {"pred", "confidence", "probabilities"} <= set(scored.columns)
    for r in scored.take(5):
        assert abs(sum(r.probabilities) - 1) < 1e-9 and r.confidence == r.probabilities[r.pred]
    linear.save(result.model, f"{tmp_path}/m")
    again = linear.predict(df, linear.load(f"{tmp_path}/m"))
    key = lambda d: sorted((r.row_id, r.pred) for r in d.collect())
    assert key(again) == key(scored)
    assert artifacts.artifact_mb(spark, f"{tmp_path}/m") > 0 == artifacts.artifact_mb(spark, f"{tmp_path}/none")
    weights = {r.label: r for r in linear.class_weights(df).collect()}
    assert abs(sum(r.n * r.weight for r in weights.values()) - 90) < 1e-3


SIX = [("यो राम्रो छ", 1), ("धेरै राम्रो काम", 1), ("यो नराम्रो छ", -1), ("धेरै नराम्रो काम", -1),
       ("ठीकै छ", 0), ("सामान्य काम", 0)]


@pytest.fixture(scope="module")
def scorer(corpus):
    rows = preprocess.resolve(corpus(SIX))
    return experiment.fit_scorer(rows, c=10.0), rows


def test_scoring_batch_and_stream(spark, scorer, tmp_path):
    model, rows = scorer
    assert all(r.pred == r.label for r in model.predict(rows).collect())
    new = spark.createDataFrame([(1, "राम्रो https://x.y"), (2, "नराम्रो"), (3, None), (4, "अज्ञात")], "id int, text string")
    batch = model.score(new).collect()
    assert {r.id: r.pred_name for r in batch if r.id < 3} == {1: "Positive", 2: "Negative"}
    assert len(batch) == 4 and all(abs(r.prob_Negative + r.prob_Neutral + r.prob_Positive - 1) < 1e-9 for r in batch)
    new.write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", new.schema, model, f"{tmp_path}/out", f"{tmp_path}/progress")
    for _ in range(2):  # the second run finds no new files and adds nothing
        score_stream(*args, keep=["id"]).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.pred, r.confidence) for r in streamed) == sorted((r.id, r.pred, r.confidence) for r in batch)
    cost = compare.run_cost("m", lambda: model.score(new))
    assert cost["rows"] == 4 and cost["elapsed_s"] > 0 and cost["ms_per_sample"] > 0
    results.append_results(experiment.result_row("m", model.predict(rows), 1.5, cost, 0.25), f"{tmp_path}/runs")
    row = results.read_results(spark, f"{tmp_path}/runs").first()
    assert row.accuracy == 1.0 and row.model_size_mb == 0.25 and row.peak_memory_mb is None and row.run_ts is not None


def test_scorer_round_trip_and_limit(spark, scorer, tmp_path, monkeypatch):
    model, rows = scorer
    model.save(f"{tmp_path}/scorer")
    again = experiment.TextScorer.load(spark, f"{tmp_path}/scorer")
    key = lambda d: sorted((r.row_id, r.pred, r.confidence) for r in d.collect())
    assert key(again.predict(rows)) == key(model.predict(rows))
    both = lambda: [key(model.predict(rows)), key(experiment.fit_scorer(rows).predict(rows))]
    shipped = both()
    monkeypatch.setattr(settings, "MAX_BROADCAST_BYTES", 0)
    for joined, plain in zip(both(), shipped):
        assert [r[:2] for r in joined] == [r[:2] for r in plain]
        assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(joined, plain))


def test_a_joined_vocabulary_scores_repeated_rows_and_streams(spark, scorer, tmp_path, monkeypatch):
    model, _ = scorer
    plain = spark.createDataFrame([(1, "राम्रो https://x.y"), (1, "राम्रो https://x.y"), (3, None), (4, "अज्ञात"), (5, "नराम्रो")], "id int, text string")
    key = lambda d: sorted((r.id, r.pred_name, round(r.confidence, 9)) for r in d.collect())
    shipped = key(model.score(plain))
    monkeypatch.setattr(settings, "MAX_BROADCAST_BYTES", 0)
    assert key(model.score(plain)) == shipped
    assert model.score(plain.limit(0)).collect() == []
    plain.write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", plain.schema, model, f"{tmp_path}/out", f"{tmp_path}/progress")
    for _ in range(2):  # the second run finds no new files and adds nothing
        score_stream(*args, keep=["id"]).awaitTermination()
    assert key(spark.read.parquet(f"{tmp_path}/out")) == shipped


def test_stream_queries_read_a_folder_of_files_and_a_single_file(spark, scorer, tmp_path, monkeypatch):
    monkeypatch.setattr(model_queries, "_scorer", lambda t: (scorer[0], None, None))
    turns = spark.createDataFrame([(i, j, "user", t) for i in range(6) for j, t in enumerate(["राम्रो", None, "नराम्रो https://x.y"])],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    turns.coalesce(1).write.parquet(f"{tmp_path}/one")
    os.makedirs(f"{tmp_path}/file")
    os.link(next((tmp_path / "one").glob("part-*.parquet")), f"{tmp_path}/file/conversations.parquet")
    for form in ("folder", "file"):
        t = Tables(spark, f"{tmp_path}/{form}")
        streamed = model_queries.stream_score(t)
        key = lambda d: sorted((r.conv_id, r.turn, r.pred, r.confidence) for r in d.collect())
        assert key(streamed) == key(model_queries.score_new_text(t)) and streamed.count() == 18
        assert [tuple(r)[2:] for r in model_queries.stream_coverage(t).collect()] == [(1, 1.0)] * 18


def test_scoring_plan_is_map_only(spark, scorer):
    plan = scorer[0].score(spark.createDataFrame([("a",)], "text string"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


# Comparison.

def test_side_by_side_and_agreement(spark, corpus):
    truth = corpus([("t" * 90, 0), ("b", 1), ("c", 2)])
    one = truth.select("row_id", F.col("label").alias("pred"))
    two = truth.select("row_id", F.lit(0).alias("pred"))
    joined = compare.join_predictions(truth, one, two)
    a = compare.model_agreement(joined).first()
    assert (a.a_correct, a.b_correct, a.agree, a.both_wrong, a.agreement) == (3, 1, 1, 0, 0.333333)
    rows = charts.prediction_table(joined).collect()
    assert len(rows[0].text) == 81 and rows[1].label_b == "Negative" and not rows[1].b_correct


def test_comparison_directions_and_ties(spark):
    flat = metrics.flat_metrics(metrics.confusion_record(
        pairs(spark, [0, 1, 2], [0, 1, 1]).withColumn("model", F.explode(F.array(F.lit("x"), F.lit("y")))), ["model"]), ["model"])
    flat = flat.withColumn("inference_ms_per_sample", F.when(F.col("model") == "x", 2.0).otherwise(1.0))
    rows = {r.metric: r.winner for r in compare.comparison_table(flat, ["x", "y"], ["inference_ms_per_sample"]).collect()}
    assert rows["accuracy"] == "x" and rows["inference_ms_per_sample"] == "y" and rows["support_Neutral"] == ""


def test_results_history(spark, tmp_path):
    path = f"{tmp_path}/r"
    for acc, ts in ((0.5, "2024-01-01"), (0.7, "2024-01-02")):
        row = spark.createDataFrame([("m", acc)], "model string, accuracy double")
        results.append_results(row.withColumn("run_ts", F.lit(ts).cast("timestamp")), path)
    table = results.read_results(spark, path)
    assert table.count() == 2 and table.schema.names == results.RESULT_SCHEMA.names
    assert compare.latest_per_model(table).first().accuracy == 0.7
    assert charts.metric_bars(table).where("metric = 'accuracy'").first().value == 0.7
    with pytest.raises(ValueError):
        results.as_result_rows(spark.createDataFrame([("m", 1)], "model string, other int"))


def test_early_stop_and_curve(spark):
    log = spark.createDataFrame(
        [(1, e, f) for e, f in enumerate([0.1, 0.3, 0.2, 0.25, 0.9], 1)] + [(2, 1, 0.5), (2, 2, 0.5)],
        "run_id int, epoch int, macro_f1 double")
    rows = {r.run_id: r for r in compare.early_stop(log).collect()}
    assert (rows[1].stop_epoch, rows[1].best_epoch) == (4, 2)
    assert (rows[2].stop_epoch, rows[2].best_epoch) == (None, 1)
    steps = [(0, 0, 0.5, 2.0, None), (0, 1, 0.9, 1.0, None), (0, 2, 1.0, None, 0.8), (0, 3, 1.0, 0.5, None)]
    curve = charts.loss_curve(spark.createDataFrame(
        steps, "run_id int, step int, epoch double, loss double, eval_loss double")).collect()
    assert [(r.epoch, r.train_loss, r.eval_loss) for r in curve] == [(1, 1.5, 0.8)]


# Arrays and neural scoring.

def test_softmax_argmax_padding(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [5, 6]), ([1000.0, 0.0, 0.0], [1, 2, 3, 4, 5])], "l array<double>, i array<int>")
    rows = df.select(ar.softmax(F.col("l")).alias("p"), ar.argmax(F.col("l")).alias("k"),
                     ar.pad(F.col("i"), 4).alias("ids"), ar.attention_mask(F.col("i"), 4).alias("m")).collect()
    e = np.exp(np.array([1.0, 3, 3]) - 3)
    assert np.allclose(rows[0].p, e / e.sum()) and rows[0].k == 1 and rows[1].p == [1.0, 0.0, 0.0]
    assert (rows[0].ids, rows[0].m) == ([5, 6, 0, 0], [1, 1, 0, 0])
    assert (rows[1].ids, rows[1].m) == ([1, 2, 3, 4], [1, 1, 1, 1])


def test_a_model_file_scores_like_the_closure_and_loads_once_per_worker(spark, tmp_path):
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(3, 4)), rng.normal(size=3)
    path, loads = f"{tmp_path}/head-of-test.npz", str(tmp_path / "loads")
    os.mkdir(loads)
    neural.save_head(spark, path, w, b)
    with pytest.raises(Exception, match="exists"):
        neural.save_head(spark, path, w, b)

    def read(local):
        open(f"{loads}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        with np.load(local) as held:
            weights, bias = held["weights"], held["bias"]
        return lambda x: x.astype("float64") @ weights.T + bias

    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(500)], "id int, v array<double>").repartition(16)
    key = lambda d: sorted((r.id, r.pred, r.confidence) for r in d.collect())
    want = key(neural.batch_score(df, neural.linear_head(w, b), "v", 4))
    assert key(neural.batch_score(df, neural.model_file(spark, path), "v", 4)) == want
    assert key(neural.batch_score(df, neural.model_file(spark, path, read), "v", 4, batch_size=8)) == want
    workers = [x.split("-")[0] for x in os.listdir(loads)]
    assert 0 < len(workers) == len(set(workers))


def test_a_missing_model_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="none.npz"):
        neural.model_file(spark, f"{tmp_path}/none.npz")


def test_batch_score(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>")
    w, b = rng.normal(size=(3, 4)), rng.normal(size=3)
    got = neural.batch_score(df, neural.linear_head(w, b), "v", 4).orderBy("id").collect()
    assert [r.pred for r in got] == (x.astype("float64") @ w.T + b).argmax(1).tolist()


def test_dense_classifier(spark, corpus, tmp_path):
    rng = random.Random(0)
    words = {-1: "bad awful poor".split(), 0: "plain table chair".split(), 1: "good great fine".split()}
    rows = [(" ".join(rng.choice(words[y]) for _ in range(8)), y) for y in (-1, 0, 1) * 40]
    df = preprocess.cleaning.normalize_labels(corpus(rows))
    model = neural.fit_dense(df, df, width=8, hidden=8, checkpoints=[20, 60], max_words=5, partitions=1)
    assert model.log.count() == 2 and model.best_epoch in (1, 2)
    scored = neural.predict_dense(df, model)
    assert linear.MacroF1().evaluate(scored) > 0.6
    model.save(f"{tmp_path}/dense")
    again = neural.DenseClassifier.load(spark, f"{tmp_path}/dense")
    key = lambda d: sorted((r.row_id, r.pred, r.confidence) for r in d.collect())
    assert key(neural.predict_dense(df, again)) == key(scored) and again.best_epoch == model.best_epoch


def test_dense_keeps_tied_words(corpus):
    df = corpus([(" ".join(f"w{i}" for i in range(50)), y) for y in (0, 1, 2)])
    kept = neural._embedding_input(df, 20).collect()
    assert [r[0] for r in kept] == [[f"w{i}" for i in range(50) if f"w{i}" in sorted(f"w{j}" for j in range(50))[:20]]] * 3


# Storage.

def test_csv_scan(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('Unnamed: 0,Sentences,Sentiment\n0,"a ""q"" b",1\n1,"x\ny, z",-1.0\n2,NA,0\n3,null,1\n4,nan,\n5,ok,nan\n',
                    encoding="utf-8")
    rows = store.scan_csv(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, r.text, r.label) for r in rows] == [
        (0, 'a "q" b', 1), (1, "x\ny, z", -1), (2, None, 0), (3, None, 1), (4, None, None), (5, "ok", None)]
    plain = tmp_path / "plain.csv"
    plain.write_text("Sentences,Sentiment\nक,1\nख,0\n", encoding="utf-8")
    assert [(r.text, r.label) for r in store.scan_csv(spark, str(plain)).orderBy("row_id").collect()] == [("क", 1), ("ख", 0)]
    with pytest.raises(AnalysisException):
        store.scan_csv(spark, str(tmp_path / "none.csv"))
    both = tmp_path / "both"
    both.mkdir()
    (both / "a.csv").write_text("Sentences,Sentiment\nx,1\n", encoding="utf-8")
    (both / "b.csv").write_text("Sentiment,Sentences\n1,x\n", encoding="utf-8")
    with pytest.raises(Exception):  # another column order is an error, never a swap
        store.scan_csv(spark, str(both)).collect()


def test_split_table(spark, corpus, tmp_path):
    path = f"{tmp_path}/s"
    out = preprocess.prepare(corpus([(f"t{i}", i % 3 - 1) for i in range(60)]))
    for _ in range(2):
        store.write_splits(out, path)
    assert store.read_split(spark, path, "train").count() == 48
    assert store.read_split(spark, path, "test").count() == 12
    with pytest.raises(FileNotFoundError):
        store.read_split(spark, path, "validation")
    with pytest.raises(AnalysisException):
        store.read_split(spark, f"{tmp_path}/none", "train")


def test_summary_and_length_tables(spark, corpus, tmp_path):
    table = spark.createDataFrame([("accuracy", 0.5, 0.4, "x")], "metric string, x double, y double, winner string")
    results.write_comparison(table, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first().winner == "x"
    assert results.read_length_stats(spark, f"{tmp_path}/l") is None
    lens = spark.createDataFrame([(1, 3), (2, 70)], "row_id bigint, n_tokens int")
    results.write_length_stats(neural.length_stats(lens, "d", "n_tokens"), lens, f"{tmp_path}/l")
    stats = results.read_length_stats(spark, f"{tmp_path}/l").first()
    assert stats.max == 70 and stats.pct_over_64 == 50.0
