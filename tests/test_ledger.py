"""Ledger hashes against plain Python over the canonical bytes."""

from __future__ import annotations

import hashlib
import json

from tallystone.operators import chains

SCHEMA = "ledger string, seq long, note string, weight double, zone string"


def _hashes(rows):
    last, out = {}, []
    for ledger, seq, note, weight, zone in rows:
        before = last.get(ledger, "GENESIS")
        entry = {"note": note, "prev_hash": before, "seq": seq, "weight": weight, "zone": zone}
        last[ledger] = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append((ledger, seq, before, last[ledger]))
    return out


def test_canonical_bytes_and_values_that_look_like_fields(spark):
    notes = ["<prev_hash>", '","prev_hash":"x', None, "", "é日\U0001f600", "a\x1f\x7f\t\"\\/", "plain"]
    rows = [(k, i, n, w, z) for k in "ab" for i, (n, w, z) in enumerate(zip(notes, [1e-7, 1.0, None, 1e20, -0.1, 123456789.123, 0.0], ["<prev_hash>", None, "z", "", "\n", "{}", "é"], strict=True))]
    built = chains.build_ledger(spark.createDataFrame(rows, SCHEMA), ["note", "seq", "weight", "zone"])
    got = [(r["ledger"], r["seq"], r["prev_hash"], r["hash"]) for r in sorted(built.collect(), key=lambda r: (r["ledger"], r["seq"]))]
    assert got == _hashes(rows)
    assert chains.ledger_faults(built, ["note", "seq", "weight", "zone"]).collect() == []


def test_fields_on_one_side_only(spark):
    rows = spark.createDataFrame([("a", i, f"n{i}") for i in range(3)], "ledger string, seq long, note string")
    for fields in (["note"], ["seq"], ["seq", "note"]):
        built = chains.build_ledger(rows, fields)
        assert chains.ledger_faults(built, fields).collect() == []
        assert [tuple(r) for r in chains.ledger_faults(built.where("seq <> 1"), fields).collect()] == [("a", 2, "prev_hash mismatch")]
