"""Chains that are longer than a stretch, and Merkle trees deeper than a round."""

from __future__ import annotations

import hashlib

import pytest

from tallystone.operators import chains, compliance, rules


def test_previous_rows_across_stretches(spark):
    rows = [(k, i * i + k, f"{k}-{i}") for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, seq long, v string")
    got = {(r["k"], r["seq"]): r["previous"] and r["previous"]["v"] for r in chains.with_previous(df, "k", "seq", "v", stretch=25).collect()}
    assert got == {(k, i * i + k): f"{k}-{i - 1}" if i else None for k in (1, 2) for i in range(40)}


def test_previous_of_a_null_key(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(30)], "k int, seq long, v long")
    got = {r["seq"]: r["previous"] and r["previous"]["v"] for r in chains.with_previous(df, "k", "seq", "v", stretch=4).collect()}
    assert got == {i: i - 1 if i else None for i in range(30)}


def _root(hashes):
    level = [hashlib.sha256(b"\0" + h.encode()).hexdigest() for h in hashes]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256("".join(sorted(level[i : i + 2])).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_roots_of_whole_chains(spark, depth):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 16, "e": 17, "f": 130, "g": 33}
    rows = [(k, i, f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    got = {r["k"]: (r["entries"], r["root"]) for r in chains.chain_roots(spark.createDataFrame(rows, "k string, pos long, h string"), "k", depth).collect()}
    assert got == {k: (n, _root([f"{k}{i}" for i in range(n)])) for k, n in sizes.items()}


def test_elements_keep_the_order_in_which_they_come(spark):
    df = spark.createDataFrame([("x", 2, ["b", "a"]), ("x", 1, ["c", "b", "c"]), ("x", 3, None), ("y", 1, [])], "k string, o int, v array<string>")
    assert {r["k"]: r["v"] for r in compliance.first_of_each(df, "k", "o", "v").collect()} == {"x": ["c", "b", "a"]}


def test_kinds_are_strict(spark):
    df = spark.createDataFrame([(1, True, "1", ["a"], None)], "n int, flag boolean, t string, l array<string>, none string")
    ask = lambda field, op, value: df.select(rules.condition(s := {"field": field, "op": op, "value": value}, df.schema), rules.missing(s, df.schema)).first()
    assert tuple(ask("n", "eq", 1)) == (True, False) and tuple(ask("n", "eq", True)) == (False, False) and tuple(ask("flag", "ne", 1)) == (True, False)
    assert tuple(ask("t", "eq", 1)) == (False, False) and tuple(ask("n", "in", ["1", 1])) == (True, False) and tuple(ask("l", "contains", "a")) == (True, False)
    for field, op, value in (("n", "gt", "0"), ("flag", "gt", 0), ("n", "contains", "1"), ("l", "matches", "a"), ("n.x", "eq", 1), ("none", "eq", "x"), ("n", "in", 1)):
        assert ask(field, op, value)[1], (field, op, value)
