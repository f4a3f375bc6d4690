"""Components of links are complete or refused."""

import pytest
from labelloom.llm.components import components


def test_components_raise_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        components(chain, max_rounds=2)
    assert {r.root for r in components(chain).collect()} == {0}
