"""Nested JSON against plain Python: leaves, hashes, layers, traces and salvage."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import nested


def _table(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "pos long, payload string")


def _plain_leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return {p: v for k, x in value.items() for p, v in _plain_leaves(x, f"{path}.{k}" if k.isidentifier() and k.isascii() else path + '."' + k.replace("\\", "\\\\").replace('"', '\\"') + '"').items()}
    if isinstance(value, list) and value:
        return {p: v for i, x in enumerate(value) for p, v in _plain_leaves(x, f"{path}[{i}]").items()}
    return {path: json.dumps(value, separators=(",", ":"), ensure_ascii=False)}


VALUES = [{"a": {"b.c": [1, {"d": None}, []], "": 2, 'q"u\\': True}, "e": "x", "g": {}}, [], {}, [[[1]], "é日"], "text", 5, None, {"é": 1, "a b": [None]}, [{"x": [{"y": [{"z": 1}]}]}]]


def test_leaves(spark):
    texts = [json.dumps(v) for v in VALUES]
    got = {}
    for r in nested.leaves(_table(spark, [*texts, None, "", "{broken", "{} x", '{"a":1}}', "5 6", "tru"]).withColumn("v", F.lit(1)), "pos", "payload").collect():
        got.setdefault(r["pos"], {})[r["path"]] = r["value"]
    assert got == {i: _plain_leaves(v) for i, v in enumerate(VALUES)}


def test_ingest_diff(spark):
    left = _table(spark, ['{"a":1,"b":[1,2]}', '{"a":1}', "{}", None, '{"x":"1"}', '{"k":1}'])
    right = _table(spark, ['{"b":[1,3,4],"a":1}', None, '{"n":{"m":0}}', '{"a":1}', '{"x":1}']).unionByName(spark.createDataFrame([(9, "[7]")], left.schema))
    rows = {tuple(r) for r in nested.ingest_diff(left, right).collect()}
    assert rows == {
        (0, "$.b[1]", "changed", "2", "3"), (0, "$.b[2]", "added", None, "4"), (1, "$.a", "removed", "1", None), (2, "$", "removed", "{}", None), (2, "$.n.m", "added", None, "0"),
        (3, "$.a", "added", None, "1"), (4, "$.x", "changed", '"1"', "1"), (5, "$.k", "removed", "1", None), (9, "$[0]", "added", None, "7"),
    }
    sets = {r["pos"]: (r["only_left"], r["only_right"]) for r in nested.key_sets(left, right).collect()}
    assert sets == {1: (["a"], []), 2: ([], ["n"]), 3: ([], ["a"]), 5: (["k"], [])}


@pytest.mark.parametrize(
    ("runs", "same", "want"),
    [
        ([(5, True), (5, True)], True, ("MATCH", 0, 0, 0)), ([(5, True), (4, True)], False, ("DIFF", 1, -1, 0)), ([(5, False), (5, True)], True, ("FAIL_CHAIN_VERIFICATION", 0, 0, 1)),
        ([(None, None), (5, None)], True, ("INCOMPLETE", 0, None, None)), ([(None, True), (5, False)], False, ("FAIL_CHAIN_VERIFICATION", 1, None, -1)), ([(5, None), (5, None)], True, ("MATCH", 0, 0, None)),
    ],
)
def test_verdicts(spark, runs, same, want):
    left = _table(spark, ['{"a":1}'])
    diff = nested.ingest_diff(left, left if same else _table(spark, ['{"a":2}']))
    table = spark.createDataFrame([(s, *r) for s, r in zip(("left", "right"), runs, strict=True)], "side string, ingested long, verified boolean")
    assert tuple(nested.ingest_verdict(diff, table).first()) == want


def _shuffled(value, rng):
    if isinstance(value, dict):
        items = [(k, _shuffled(v, rng)) for k, v in value.items()]
        rng.shuffle(items)
        return dict(items)
    return [_shuffled(v, rng) for v in value] if isinstance(value, list) else value


def test_hashes_pass_over_the_order_of_names_but_not_of_lists(spark):
    rng = random.Random(1)
    texts = [json.dumps(_shuffled(v, rng)) for v in VALUES for _ in range(3)]
    rows = nested.semantic_hashes(_table(spark, [*texts, None, "{no"]), "pos", "payload")
    hashes = {r["pos"]: r["semantic_hash"] for r in rows.collect()}
    assert all(hashes[3 * i] == hashes[3 * i + 1] == hashes[3 * i + 2] for i in range(len(VALUES)))
    assert len({hashes[3 * i] for i in range(len(VALUES))}) == len(VALUES)
    assert hashes[len(texts)] is None and hashes[len(texts) + 1] is None
    classes = {r["pos"]: (r["representative"], r["class_size"]) for r in nested.equivalence_classes(rows, "pos").collect()}
    assert classes == {i: (i // 3 * 3, 3) for i in range(len(texts))} | {len(texts) + i: (len(texts) + i, 1) for i in range(2)}
    lists = nested.semantic_hashes(_table(spark, ["[1,2]", "[2,1]", '{"a":1,"evaluator":{"v":2}}', '{"evaluator":[],"a":1}', '{"evaluator":1}', "{}"]), "pos", "payload", ["evaluator"])
    h = {r["pos"]: r["semantic_hash"] for r in lists.collect()}
    assert h[0] != h[1] and h[2] == h[3] and h[4] == h[5]


def test_names_at_any_depth(spark):
    texts = ['{"a":{"b":[{"c d":1}]},"e":"\\"f\\":1"}', '{"x\\"y":":{","z":["k:"]}', "[]", '{"a" : {"a":1}}', None]
    rows = _table(spark, texts).select("pos", nested.keys_at_any_depth(F.col("payload")).alias("k")).collect()
    assert [r["k"] for r in sorted(rows)] == [["a", "b", "c d", "e"], ['x"y', "z"], [], ["a", "a"], None]


def test_layers(spark):
    ask = lambda *values: nested.layered(_table(spark, [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]), "pos", "payload", ["ruling"], ["blame"], ["is proven"])
    none = ("classification", "", None, 0.5)
    cases = [
        ({}, None, [none]),
        ({"fact_layer": {"f": "x", "g": 1, "h": None}, "classification_layer": {"routing": "r", "confidence": "0.75"}}, None, [("fact", "x", "f", None), ("classification", "r", None, 0.75)]),
        ({"classification_layer": {"routing": 3, "confidence": "odd"}}, None, []),
        ({"classification_layer": {"routing": "r", "confidence": [1]}}, "confidence is no number", None),
        ({"classification_layer": {"confidence": True}}, None, [("classification", "", None, 1.0)]),
        ({"classification_layer": [], "fact_layer": 5, "interpretation_layer": {"statements": "no list"}}, None, []),
        ({"interpretation_layer": {"statements": ["seen", 5, ["x"], "blame: not a name"]}}, None, [none, ("interpretation", "seen", None, None), ("interpretation", "blame: not a name", None, None)]),
        ({"interpretation_layer": {"statements": ["It IS Proven"]}}, "forbidden language", None),
        ({"interpretation_layer": {"more": [{"deep": {"blame": 0}}]}}, "forbidden in interpretation: blame", None),
        ({"fact_layer": {"blame": 1}, "ruling": 1}, "forbidden at the top: ruling", None),
        ({"fact_layer": {"x": {"blame": 1}}}, "forbidden in facts: blame", None),
        ({"fact_layer": ["blame"], "other": {"blame": 1}}, None, [none]),
        ([1], "not an object", None),
        ("{", "not an object", None),
        (None, "not an object", None),
    ]
    rows = sorted(ask(*(c[0] for c in cases)).collect())
    for r, (value, reason, statements) in zip(rows, cases, strict=True):
        assert (r["reason"], r["statements"] and [tuple(s) for s in r["statements"]]) == (reason, statements and [*statements] or (None if statements is None else [])), value


def test_strict_traces(spark):
    good = {"ts_ns": 5, "engine": "e", "event": "ev", "payload": {"wu_id": 7, "z": [1], "sig": "inner"}, "prev_hash": "h", "sig": "s"}
    changed = lambda **k: json.dumps({n: v for n, v in (good | k).items() if v != "gone"})
    cases = [
        (json.dumps(good), None, "7"), (changed(payload=None), None, "h"), (changed(payload="gone"), None, "h"), (changed(payload={"wu_id": None}), None, "None"), (changed(payload={"scenario_id": True}), None, "True"),
        (changed(payload={"reason": "why"}), None, "h"), (changed(payload={"reason": None}), None, "h"), (changed(ts_ns="5"), "ts_ns must be an int", None), (changed(ts_ns=1.5), "ts_ns must be an int", None), (changed(ts_ns="gone"), "ts_ns is missing", None),
        (changed(event=3), "event must be a string", None), (changed(payload=[]), "payload must be an object", None), (changed(engine=None), "engine must be a string", None), (changed(prev_hash="gone"), "prev_hash is missing", None), (changed(sig=1), "sig must be a string", None),
        (changed(payload={"reason": 1}), "payload.reason must be a string", None), ("[1]", "not an object", None), ("{", "not JSON", None), (json.dumps(good) + " x", "not JSON", None), (" " + json.dumps(good) + "\t", None, "7"),
    ]
    rows = sorted(nested.strict_traces(_table(spark, [*(c[0] for c in cases), "", "  ", None]), "pos", "payload").collect())
    assert [(r["reason"], r["scenario_id"]) for r in rows] == [c[1:] for c in cases]
    assert json.loads(rows[0]["metadata"]) == {"engine": "e", "prev_hash": "h", "sig": "s", "wu_id": 7, "z": [1], "zarc_event": "ev"}
    assert list(json.loads(rows[0]["metadata"])) == sorted(json.loads(rows[0]["metadata"]))
    assert [r["fault_reason"] for r in rows[:7]] == [None] * 5 + ["why", None]
    assert all(tuple(r)[2:] == (None,) * 5 for r in rows if r["reason"])


def test_salvage(spark):
    cases = [
        ('{"a":1}', '{"a":1}'), ("so: {\"a\":\"}]\\\" {\"} done }", '{"a":"}]\\" {"}'), ("[1,[2]] and {", "[1,[2]]"), ("```json\n{\"a\":1}\n```", '{"a":1}'), ("```\nno\n``` x ```JSON\n[2]\n``` ```{}```", "[2]"),
        ("{'a':1,}", '{"a":1}'), ("x {'a':[1,],'b':'c'} y", '{"a":[1],"b":"c"}'), ("{ \"a\": 1", None), ("no brackets", None), ("", None), (None, None), ("5", None), ("} {", None), ("{a} {\"b\":1}", None), ("{\"k\":{\"l\":[{}]}} tail \" [", '{"k":{"l":[{}]}}'),
    ]
    rows = sorted(_table(spark, [c[0] for c in cases]).select("pos", nested.salvaged(F.col("payload")).alias("f"), nested.salvaged(F.col("payload"), repair=False).alias("g")).collect())
    assert [r["f"] for r in rows] == [c[1] for c in cases]
    assert [r["g"] for r in rows] == [None if "'" in (c[0] or "") else c[1] for c in cases]
    long = '{"s":"' + "x}\\n" * 5000 + '","l":[' + ",".join(["[]"] * 300) + "]}"
    assert _table(spark, ["say " + long + " {"]).select(nested.salvaged(F.col("payload"))).first()[0] == long
