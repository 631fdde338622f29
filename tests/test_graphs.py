"""Components and witness cycles against a plain version."""

from __future__ import annotations

import random

import pytest

from tallystone.operators import graphs


def _reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def _plain(pairs):
    out = {}
    for a, b in pairs:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    reach = {a: _reach(out, a) for a in out}
    return out, {a: min(b for b in reach[a] | {a} if b == a or a in reach.get(b, ())) for a in out if a in reach[a]}


def _check(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    members = graphs.components(edges)
    out, want = _plain(pairs)
    assert {r["node"]: r["component"] for r in members.collect()} == want
    found = {}
    for r in graphs.witnesses(edges, members).collect():
        found.setdefault(r["component"], {})[r["position"]] = r["node"]
    assert set(found) == set(want.values())
    for component, steps in found.items():
        cycle = [steps[i] for i in range(len(steps))]
        assert cycle[0] == component and all(b in out[a] for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True))
        # No shorter one leads through the least node.
        front, n = {component}, 0
        while component not in front or not n:
            front, n = {b for a in front for b in out.get(a, ())}, n + 1
        assert n == len(cycle)


def test_nodes_behind_a_cycle_are_not_on_it(spark):
    _check(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (0, 1)])


def test_two_cycles_joined_one_way_share_no_component(spark):
    _check(spark, [(5, 6), (6, 7), (7, 5), (7, 1), (1, 2), (2, 3), (3, 1), (9, 9), (9, 5), (4, 4), (3, 4)])


def test_repeats_nulls_and_empty(spark):
    _check(spark, [(1, 2), (1, 2), (2, 1), (None, 1), (2, None), (None, None)])
    _check(spark, [(1, 2), (2, 3)])
    _check(spark, [])


def test_a_long_cycle_and_a_long_tail(spark):
    _check(spark, [(i, (i + 1) % 12) for i in range(12)] + [(20 + i, 21 + i) for i in range(8)] + [(28, 3), (5, 40), (40, 41)])


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    _check(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(50 + 5 * seed)])
