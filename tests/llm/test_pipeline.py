"""The pipeline against the same steps in plain Python, and its contract."""

from collections import Counter

import corpus_pipeline
from labelloom.llm import quality, queries
from pyspark.sql import functions as F
from test_dedup_ops import line_groups
from test_near_dedup import jaccard_groups
from test_text_ops import contamination, digests

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_steps(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    assert 100 < len(rows) < 200
    lined = [(d, t) for (d, _, gone, t), n in line_groups(spark, rows).items() if not gone or t.strip()]
    one = [(d, dict(lined)[d]) for d, low in jaccard_groups(lined).items() if d == low]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, *_, hit in contamination(one, items) if hit}
    assert (len(bad), len(lined) - len(one)) > (0, 0), (len(rows), len(lined), len(one), len(bad))
    want = digests(sentencepiece.SentencePieceProcessor(model_file=queries.piece_model()), [r for r in one if r[0] not in bad])
    got = corpus_pipeline.run(spark, SMALL)
    assert Counter(tuple(r[:4]) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    ids = got.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h"), "ids_sha256", F.size("ids").alias("n"), "n_tokens")
    assert ids.where("h <> ids_sha256 or n <> n_tokens").count() == 0


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 40, "en", "s", 200), (4, "a\n" * 3000, "x", "y", 6000),
            (5, "Plain words stand here in a row that is long enough for the rules to keep it.", "en", "s", 77)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() <= 1


