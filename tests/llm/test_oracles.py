"""The training-data queries that have SQL, against DuckDB."""

import os

import pytest

from quillrank.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) == ""
