"""Rule-set documents, CSV samples and signatures of blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallystone.operators import chains, rules
from tallystone.sources import files

RULE = {"id": "a", "when": {"field": "x", "op": "eq", "value": 1}, "then": {"verdict": "deny", "reason": "so"}}


def test_rule_set(spark):
    version, found, digest = rules.rule_set({"version": "1", "rules": [RULE]})
    assert (version, found) == ("1", [{"id": "a", "when": RULE["when"], "verdict": "deny", "reason": "so"}])
    assert rules.rule_set({"rules": [dict(reversed(RULE.items()))], "version": "1"})[2] == digest
    assert rules.rule_set({"version": "2", "rules": [RULE]})[2] != digest


@pytest.mark.parametrize(
    "document",
    [{}, {"version": "", "rules": [RULE]}, {"version": "1", "rules": []}, {"version": "1", "rules": [RULE, RULE]}, {"version": "1", "rules": [5]}, {"version": "1", "rules": [RULE | {"id": ""}]}, {"version": "1", "rules": [RULE | {"then": {"verdict": "odd"}}]}, {"version": "1", "rules": [RULE | {"then": {"verdict": "deny", "reason": 1}}]}],
)
def test_documents_that_are_no_rule_sets(spark, document):
    with pytest.raises(ValueError):
        rules.rule_set(document)


def test_csv_samples(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,"a, ""b"""\n1,\xff\n\n"two\nlines",3\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("".join(f"{i}\n" for i in range(50)))
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = {}
    for r in files.csv_samples(raw, 20).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["n"], r["cells"]))
    assert sorted(got["a.csv"]) == [(0, ["x", 'a, "b"']), (1, ["1", "�"]), (2, []), (3, ["two\nlines", "3"])]
    assert "b.csv" not in got and len(got["c.csv"]) == 20


def test_block_signatures(spark):
    records = spark.createDataFrame([("t", b, 0, f"h{b}") for b in range(4)], "tenant string, block long, slot int, h string")
    made = chains.block_chain(chains.merkle_roots(records, "tenant", "block"), "tenant").select("tenant", "block", F.lit(0).alias("record_count"), F.col("root").alias("merkle_root"), F.sha2("root", 256).alias("integrity_hash"))
    linked = chains.with_previous(made, "tenant", "block", "integrity_hash").withColumn("previous", F.coalesce("previous.integrity_hash", F.lit(chains.GENESIS)))
    checked = lambda signed: chains.block_checks(linked.withColumn("signature_valid", signed), records, "tenant").first()["problems"].split(",")
    assert checked(F.col("block") != 0)[0] == "SIGNATURE_INVALID"
    assert "SIGNATURE_INVALID" not in checked(F.when(F.col("block") > 0, F.lit(True)))
