"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from compare import differences, duck

from tallystone.llm.oracles import ORACLES
from tallystone.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    assert differences(df.collect(), df.columns, duck(small), ORACLES[name]) == ""
