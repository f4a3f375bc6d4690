import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from labelloom.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows) -> DataFrame(row_id, text, label), numbered in the given order."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, y) for i, (t, y) in enumerate(rows)], "row_id bigint, text string, label int")
    return make
