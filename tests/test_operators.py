"""Hand-made cases of single operators."""

from __future__ import annotations

import pytest

from tallystone.functions.canon import canonical, canonical_json
from tallystone.operators import chains, claims, forensics, fusion, placement, rules, stateful, telemetry

STREAM = "stream_id long, type string, subject string, source_tier int, claim string, confidence double, severity_impact double, ts timestamp_ntz, half_life double, provenance_hash string, signature_valid boolean"


def _streams(spark, *rows):
    from datetime import datetime, timedelta

    now = datetime(2024, 2, 1)
    return spark.createDataFrame([(i, "t", "s", tier, claim, c, c, now - timedelta(hours=age), life, f"h{i}", True) for i, (tier, claim, c, age, life) in enumerate(rows)], STREAM)


def test_half_life_halves_freshness(spark):
    out = fusion.scored(_streams(spark, (1, "positive", 1.0, 24, 24.0), (1, "neutral", 1.0, 24, None)), "2024-02-01 00:00:00").orderBy("stream_id").collect()
    assert [r["freshness"] for r in out] == [0.5, 1.0]
    assert out[0]["composite"] == pytest.approx(0.35 + 0.125 + 0.25)


def test_tier_gap_comes_before_score(spark):
    s = _streams(spark, (1, "positive", 0.5, 1, None), (4, "negative", 1.0, 1, None))
    out = fusion.arbitrated(fusion.conflicts(fusion.scored(s, "2024-02-01 00:00:00"))).first()
    assert (out["rule"], out["winner"]) == ("authority", 0)


def test_future_streams_are_split_off(spark):
    keep, gone = fusion.split_future(_streams(spark, (1, "neutral", 1.0, -1 / 60, None), (1, "neutral", 1.0, -61 / 3600, None)), "2024-02-01 00:00:00")
    assert (keep.count(), gone.count()) == (1, 1)


def test_empty_streams(spark):
    s = spark.createDataFrame([], STREAM)
    assert fusion.flagged(s, "2024-02-01 00:00:00").count() == 0
    assert fusion.sensitivity(s, "2024-02-01 00:00:00").count() == 0


def test_chain_verifies_and_breaks(spark):
    rows = chains.build_chain(spark.createDataFrame([("a", i, f"p{i}") for i in range(5)], "chain string, seq long, payload string"))
    assert chains.first_break(chains.verify_chain(rows)).first()["first_break"] is None
    assert chains.first_break(chains.verify_chain(rows.where("seq <> 2"))).first()["first_break"] == 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_every_leaf_has_a_proof(spark, n):
    leaves = spark.createDataFrame([("b", i, f"h{i}") for i in range(n)], "block string, slot int, h string")
    proofs = chains.inclusion_proofs(chains.merkle_levels(leaves, "block"), "block")
    assert proofs.where(chains.proof_holds()).count() == n


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", v) for v in range(1, 21)] + [("b", 7)], "k string, v long")
    out = {r["k"]: r for r in telemetry.exact_ranks(rows, "v", "k").collect()}
    assert (out["a"]["p50"], out["a"]["p95"], out["a"]["max"]) == (10.5, 20, 20)
    assert out["b"]["p95"] == 7


def test_decision_table(spark):
    f = spark.createDataFrame([("retrieval", 5), ("compression", 5)], "family string, n long")
    assert telemetry.decision(f, 10).first()["verdict"] == "PHASE_4"
    assert telemetry.decision(f, 21).first()["verdict"] == "UNDERPOWERED"
    assert telemetry.decision(f.limit(0)).first()["verdict"] == "UNDERPOWERED"
    assert telemetry.decision(f.limit(0), 0).first()["verdict"] == "LINE_HEALTHY"


def test_policy_fails_closed(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    policy = [{"id": "r", "verdict": "allow", "when": {"field": "x", "op": "gt", "value": 3}}]
    assert [r["verdict"] for r in rules.verdicts(rows, policy).orderBy("id").collect()] == ["deny", "allow"]
    with pytest.raises(ValueError):
        rules.check_rules(policy * 2)
    with pytest.raises(ValueError):
        rules.condition({"field": "x", "op": "near", "value": 1})


def test_sentences_split_before_capitals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("It was a long day. Then the night came! no. End",)], "t string")
    assert df.select(claims.sentences(F.col("t"))).first()[0] == ["It was a long day.", "Then the night came! no."]


def test_canonical_json(spark):
    assert canonical('{"b": 1, "a": [1.0, "é"]}') == '{"a":[1.0,"é"],"b":1}'
    assert canonical("NaN") is None and canonical("{") is None
    df = spark.createDataFrame([('{"b":1,"a":2}',), (None,)], "j string")
    assert [r[0] for r in df.select(canonical_json("j")).collect()] == ['{"a":2,"b":1}', None]


def test_byte_statistics_of_nothing(spark):
    out = forensics.byte_statistics(spark.createDataFrame([(1, None), (2, "aaaa"), (3, "ab")], "id long, t string"), "id", "t").orderBy("id").collect()
    assert [(r["n_bytes"], r["entropy"]) for r in out] == [(0, 0.0), (4, 0.0), (2, 1.0)]


def test_cycle_is_found(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 1)], "a long, b long")
    assert {r["node"] for r in placement.cycles(e).collect()} == {2, 3, 4}
    assert {r["node"]: r["depth"] for r in placement.reachable_depth(e.where("NOT (a = 3 AND b = 2)")).collect()} == {5: 0, 1: 1, 2: 2, 3: 3, 4: 4}


def test_capacity_gate_by_hand(spark):
    acts = [("start", 6, 1), ("start", 6, 1), ("start", 1, 9), ("end", 0, 0), ("start", 6, 1), ("end", 0, 0), ("end", 0, 0)]
    rows = spark.createDataFrame([("k", i, *a) for i, a in enumerate(acts)], "k string, n long, act string, need_dt long, need_tu long")
    out = stateful.capacity_gate(rows, "k", "n", 10, 8, 1).orderBy("n").collect()
    assert [r["result"] for r in out] == ["run", "wait", "reject", "release", "run", "release", "idle"]


def test_job_lifecycle_by_hand(spark):
    reports = [(0, "fail"), (3, "fail"), (9, "fail"), (12, "ok")]
    rows = spark.createDataFrame([("a", i, t, w) for i, (t, w) in enumerate(reports)] + [("b", 0, 0, "fail"), ("b", 1, 60, "ok")], "k string, n long, tick long, what string")
    out = stateful.job_lifecycle(rows, "k", "n", "tick", "what", 2, 50).orderBy("k", "n").collect()
    assert [(r["state"], r["due"]) for r in out] == [("retry", 2), ("retry", 7), ("failed", 0), ("archived", 0), ("retry", 2), ("timed_out", 0)]


def test_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(100).selectExpr("id % 2 AS k", "id AS n", "1L AS x")
        out = stateful.fold(rows, "k", "n", ["x"], lambda: {"s": 0}, lambda s, x: s.update(s=s["s"] + x) or {"s": s["s"]}, "s long")
        assert {r["s"] for r in out.where("n >= 98").collect()} == {50}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
