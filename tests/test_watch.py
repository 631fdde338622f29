"""Watched chains: the stream against the batch form, over many batches, out of order, and frozen for good."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallystone.operators import chains
from tallystone.plans.blocks import _watchable
from tallystone.streaming import streams

SCHEMA = "chain string, height long, hash string, previous string, own_fault string"


def _stream(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)  # files are taken in the order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _drained(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, stream.sparkSession.table(name).collect()), key=str)


def _chain(name, n, spoiled=None, fault=None):
    """An intact chain of n blocks, or one with a fault at a height."""
    rows = []
    for h in range(n):
        previous = rows[-1][2] if rows else chains.GENESIS
        rows.append((name, h, f"{name}{h}", previous, None))
    if fault == "CHAIN_BREAK":
        rows[spoiled] = (*rows[spoiled][:3], "other", None)
    elif fault == "HEIGHT_GAP":
        del rows[spoiled]
    elif fault:
        rows[spoiled] = (*rows[spoiled][:4], fault)
    return rows


@pytest.mark.parametrize("slack", [1, 5])
def test_stream_equals_batch(spark, tmp_path, slack):
    """Chains dealt over eight batches; with slack, blocks come up to four heights early, and some twice."""
    rng = random.Random(slack)
    rows = [r for i in range(12) for r in _chain(f"c{i}", 30, 5 + i, [None, "CHAIN_BREAK", "HEIGHT_GAP", "HASH_MISMATCH"][i % 4])]
    batches = [[] for _ in range(8)]
    for r in sorted(rows, key=lambda r: r[1] + rng.random() * (slack - 1)):
        batches[min(7, r[1] // 4)].append(r)
    if slack > 1:
        batches = [[r for r in rows if min(7, max(0, r[1] - (r[1] * 7) % 5) // 4) == i] for i in range(8)]
        batches = [b + rng.sample(rows, 3) if i == 7 else b for i, b in enumerate(batches)]
    for b in batches:
        rng.shuffle(b)
    want = sorted(map(tuple, chains.watched_blocks(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    got = _drained(streams.watched(_stream(spark, tmp_path / "in", batches), slack), tmp_path, f"watched{slack}")
    assert got == want
    faults = {r[0]: (r[1], r[2]) for r in got if r[2]}
    assert len(faults) == 9 and faults["c1"] == (6, "CHAIN_BREAK") and faults["c2"] == (8, "HEIGHT_GAP") and faults["c3"] == (8, "HASH_MISMATCH")
    assert all(r[1] <= faults[r[0]][0] for r in got if r[0] in faults)  # nothing behind a freeze


def test_frozen_for_good_over_a_restart(spark, tmp_path):
    rows = _chain("a", 9, 2, "CHAIN_BREAK")
    assert [r[1] for r in _drained(streams.watched(_stream(spark, tmp_path / "in", [rows[:4]]), 1), tmp_path, "first")] == [0, 1, 2]
    spark.createDataFrame(rows[4:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.watched(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 1)
    found = []
    q = stream.writeStream.foreachBatch(lambda df, i: found.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "first")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert found == []


def test_patience_ends_a_wait(spark, tmp_path):
    rows = _chain("a", 6, 3, "HEIGHT_GAP")
    stream = streams.watched(_stream(spark, tmp_path / "in", [rows]), 64, patience_ms=500)
    found = []
    q = stream.writeStream.foreachBatch(lambda df, i: found.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    for _ in range(150):
        if len(found) > 3:
            break
        time.sleep(0.2)
    q.stop()
    assert sorted(found, key=lambda r: r[1])[3:] == [("a", 4, "HEIGHT_GAP", "3", "4")]


def test_lines_over_batches(spark, tmp_path):
    """An intact chain has no break in any batch; an edited line breaks at the line behind it."""
    built = chains.build_chain(spark.createDataFrame([(c, i, f"p{i}") for c in "ab" for i in range(10)], "chain string, seq long, payload string"))
    edited = built.withColumn("line", F.when((F.col("chain") == "b") & (F.col("seq") == 6), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    for low in (0, 5, 8):
        edited.where(f"seq >= {low} AND seq < {dict([(0, 5), (5, 8), (8, 10)])[low]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
    breaks = []
    lines = spark.readStream.schema(built.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))
    streams.watch_chain(lines, lambda i, rows: breaks.extend((r["chain"], r["seq"], r["fault"]) for r in rows.collect()), str(tmp_path / "cp")).awaitTermination()
    assert breaks == [("b", 7, "CHAIN_BREAK")]


def test_query_rows_as_a_stream(spark, small, tmp_path):
    blocks = _watchable(spark, small).withColumn("chain", F.col("chain").cast("string"))
    parts = blocks.withColumn("part", F.least(F.floor(F.col("height") / 5), F.lit(3)))
    batches = [[tuple(r)[:5] for r in parts.where(f"part = {i}").collect()] for i in range(4)]
    want = sorted(map(tuple, chains.watched_blocks(blocks).collect()), key=str)
    assert _drained(streams.watched(_stream(spark, tmp_path / "in", [b for b in batches if b]), 1), tmp_path, "rows") == want


def test_report_and_odd_tables(spark):
    rows = [*_chain("a", 3), *_chain("b", 4, 1, "SIGNATURE_INVALID"), *_chain("c", 1)]
    report = {r["chain"]: tuple(r)[1:] for r in chains.integrity_report(chains.watched_blocks(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert report == {"a": (3, 3, True, None, None, None, None), "b": (2, 1, False, "SIGNATURE_INVALID", 1, None, None), "c": (1, 1, True, None, None, None, None)}
    assert chains.watched_blocks(spark.createDataFrame([], SCHEMA)).collect() == []
    null = chains.watched_blocks(spark.createDataFrame([(None, 0, "x", None, None), (None, 1, "y", "x", None)], SCHEMA)).collect()
    assert [tuple(r)[:3] for r in null] == [(None, 0, "CHAIN_BREAK")]
