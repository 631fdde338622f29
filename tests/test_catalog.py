"""Every registered query of the library proper against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

from tallystone.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    assert differences(df.collect(), df.columns, con, catalog.ORACLES[name]) == ""


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
