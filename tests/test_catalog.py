"""Every registered query with check SQL gives the same rows as DuckDB at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
