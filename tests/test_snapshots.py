"""Writers that die between two steps, repeated appends, and what stays on storage."""

import os

import pytest
from pyspark.errors import AnalysisException

from labelloom.sources import corpus as store, results, snapshots


def split_rows(spark, text):
    return spark.createDataFrame([(1, text, 0, "train"), (2, text, 1, "test")], store.SPLIT_SCHEMA)


def texts(spark, path):
    return [r.text for r in store.read_split(spark, path, "train").collect()]


def test_a_writer_that_dies_leaves_the_former_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/splits"
    with pytest.raises(AnalysisException):
        store.read_split(spark, path, "train")
    store.write_splits(split_rows(spark, "first"), path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", dies)
        with pytest.raises(RuntimeError, match="lost"):
            store.write_splits(split_rows(spark, "second"), path)
    assert texts(spark, path) == ["first"]
    reader = store.read_split(spark, path, "train")
    store.write_splits(split_rows(spark, "third"), path)
    assert texts(spark, path) == ["third"]
    assert [r.text for r in reader.collect()] == ["first"]  # a reader of the former version goes on
    store.write_splits(split_rows(spark, "fourth"), path)
    held = [n for n in os.listdir(path) if n.startswith("version-")]
    assert texts(spark, path) == ["fourth"] and len(held) == 2 == len(snapshots.versions(spark, path))


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/runs"
    row = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    for run in ("a", "a", "b", None, None):
        results.append_results(row, path, run)
    assert results.read_results(spark, path).count() == 4
    os.remove(f"{path}/run=b/_SUCCESS")  # broken off: written anew
    results.append_results(row, path, "b")
    assert results.read_results(spark, path).count() == 4
    assert results.read_results(spark, path).schema == results.RESULT_SCHEMA


def test_length_tables_change_together(spark, tmp_path):
    path = f"{tmp_path}/lengths"
    frame = lambda n: spark.createDataFrame([(n,)], "n int")
    assert results.read_length_stats(spark, path) is None
    results.write_length_stats(frame(1), frame(10), path)

    class Dies:
        sparkSession = spark

        @property
        def write(self):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        results.write_length_stats(frame(2), Dies(), path)
    assert results.read_length_stats(spark, path).first().n == 1
