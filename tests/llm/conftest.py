import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "text string, doc_id bigint, lang string, segment int, fp string, key string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """[(doc_id, text)] -> documents in two partitions, with extra columns that clash with working names."""
    def make(rows):
        return spark.createDataFrame([(t, i, None, 1, "x", "y") for i, t in rows], SCHEMA).repartition(2)
    return make


@pytest.fixture(scope="session")
def corpus_rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
