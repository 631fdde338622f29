"""Sealing against a plain fold over short stretches; trees and proofs against plain ones."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallystone.operators import blocks, chains


def _fold(rows, most, age):
    """(key, block, first, last, n, age, reason) of (key, ts, ord) rows."""
    out = []
    for key in {r[0] for r in rows}:
        held, n = [], 0
        mine = sorted(r[1:] for r in rows if r[0] == key and r[1] is not None)
        for i, r in enumerate(mine):
            held.append(r)
            old = r[0] - held[0][0] >= age
            if len(held) == most or old or i == len(mine) - 1:
                out.append((key, n, held[0][1], held[-1][1], len(held), r[0] - held[0][0], "records" if len(held) == most else "age" if old else "open"))
                held, n = [], n + 1
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "age", "stretch"), [(5, 40, 5), (5, 40, 7), (3, 1, 16), (1, 10, 4), (50, 30, 50), (8, 10**9, 9)])
def test_seals_as_a_fold_does(spark, most, age, stretch):
    rng = random.Random(most)
    rows = [("hot", rng.randrange(2000), i) for i in range(300)] + [("few", rng.randrange(50), i) for i in range(1000, 1012)] + [(None, 3 * i, 2000 + i) for i in range(20)]
    rows += [("tie", 7, 3000 + i) for i in range(23)] + [("one", 1, 4000), ("none", None, 4001), ("hot", None, 4002)]
    df = spark.createDataFrame(rows, "tenant string, ts long, seq long").withColumn("key", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(6)
    got = sorted(map(tuple, blocks.sealed_blocks(df, "tenant", "ts", "seq", most, age, stretch).collect()), key=str)
    assert got == _fold(rows, most, age)


def test_empty_tables(spark):
    assert blocks.sealed_blocks(spark.createDataFrame([], "tenant string, ts long, seq long"), "tenant", "ts", "seq").collect() == []
    nodes = blocks.tree_nodes(spark.createDataFrame([], "k string, pos long, h string"), "k")
    assert nodes.collect() == []
    assert blocks.entry_proofs(nodes, spark.createDataFrame([("a", 0)], "k string, pos long"), "k").collect() == []


def _levels(hashes):
    levels = [[hashlib.sha256(b"\0" + h.encode()).hexdigest() for h in hashes]]
    while len(levels[-1]) > 1:
        level = levels[-1] + levels[-1][-1:] * (len(levels[-1]) % 2)
        levels.append([hashlib.sha256("".join(sorted(level[i : i + 2])).encode()).hexdigest() for i in range(0, len(level), 2)])
    return levels


SIZES = {"a": 1, "b": 2, "c": 3, "d": 16, "e": 17, "f": 130, "g": 33}


@pytest.mark.parametrize("depth", [1, 3, 7])
def test_nodes_and_proofs(spark, depth, monkeypatch):
    monkeypatch.setattr(blocks, "SALTED_LEVEL", 2)
    leaves = spark.createDataFrame([(k, i, f"{k}{i}") for k, n in SIZES.items() for i in range(n)], "k string, pos long, h string")
    want = {k: _levels([f"{k}{i}" for i in range(n)]) for k, n in SIZES.items()}
    nodes = blocks.tree_nodes(leaves, "k", depth).cache()
    assert {(r["k"], r["level"], r["pos"]): r["h"] for r in nodes.collect()} == {(k, d, i): h for k, levels in want.items() for d, level in enumerate(levels) for i, h in enumerate(level)}
    asked = leaves.select("k", "pos").union(spark.createDataFrame([("a", 1), ("b", -1), ("zz", 0), ("b", 0), (None, 0)], "k string, pos long"))
    rows = blocks.entry_proofs(nodes, asked, "k").withColumn("holds", chains.proof_holds()).collect()
    assert {(r["k"], r["pos"]) for r in rows} == {(k, i) for k, n in SIZES.items() for i in range(n)} and len(rows) == sum(SIZES.values())
    for r in rows:
        levels, pos = want[r["k"]], r["pos"]
        assert (r["leaf"], r["root"], r["holds"]) == (levels[0][pos], levels[-1][0], True)
        assert r["proof"] == [level[(pos >> d) ^ 1] if (pos >> d) ^ 1 < len(level) else level[pos >> d] for d, level in enumerate(levels[:-1])]


def test_every_hundredth_entry_of_a_long_chain(spark, tmp_path):
    leaves = spark.range(100_000).select(F.lit("chain").alias("k"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    blocks.tree_nodes(leaves, "k").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    proofs = blocks.entry_proofs(nodes, leaves.where("pos % 100 = 0"), "k")
    forged = F.aggregate("proof", F.sha2("leaf", 256), chains._parent) == F.col("root")
    counts = proofs.agg(F.count(F.lit(1)), F.count_if(chains.proof_holds()), F.count_if(forged), F.min(F.size("proof")), F.max(F.size("proof"))).first()
    assert tuple(counts) == (1000, 1000, 0, 17, 17)
    assert proofs.first()["root"] == chains.chain_roots(leaves, "k").first()["root"]
