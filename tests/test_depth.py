"""Depths of chains: no level is lost, and running out of rounds is said."""

from __future__ import annotations

import pytest

from tallystone.operators import placement


def _chain(spark, n):
    return spark.range(n).selectExpr("id AS a", "id + 1 AS b")


def test_running_out_of_rounds_raises(spark):
    with pytest.raises(RuntimeError, match="deeper than 3"):
        placement.reachable_depth(_chain(spark, 5), max_rounds=3)


def test_a_chain_as_deep_as_the_rounds_is_whole(spark, monkeypatch):
    monkeypatch.setattr(placement, "CUT_LEVELS", 2, raising=False)
    got = {r["node"]: r["depth"] for r in placement.reachable_depth(_chain(spark, 5), max_rounds=6).collect()}
    assert got == {i: i for i in range(6)}
