from __future__ import annotations

import sqlite3
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from tallystone.operators import chains, stateful
from tallystone.sources import files
from tallystone.streaming import streams


def test_chain_round_trip(spark, tmp_path):
    built = chains.build_chain(spark.createDataFrame([("a", i, f"p{i}") for i in range(4)], "chain string, seq long, payload string"))
    files.append_chain(built, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    (tmp_path / "c.jsonl").write_text('{"ts_ns":1,"engine":"e","event":"x","payload":{"k":1},"prev_hash":"0","sig":null}\nbroken\n')
    rows = files.read_chain(spark, str(tmp_path / "c.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["engine"], r["payload"]) for r in rows] == [(0, "e", '{"k":1}'), (1, None, None)]


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "m.eml").write_text("From: a@x.example\nTo: b@y.example\nSubject: Re: hi\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nReceived: from q\n\nbody\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w><t>some</t><t>text</t></w>")
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE t (a, b)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, None) for i in range(150)])
    con.commit()
    con.close()
    kinds = {Path(r["path"]).name: r["kind"] for r in files.walk(spark, str(tmp_path)).collect()}
    assert kinds == {"a.pdf": "pdf", "m.eml": "text", "d.docx": "zip", "s.db": "sqlite"}
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    mail = files.mail_planes(raw.where("path LIKE '%.eml'")).first()
    assert (mail["sender"], mail["hops"], mail["body"].strip()) == ("a@x.example", 1, "body")
    office = files.office_planes(raw.where("path LIKE '%.docx' OR path LIKE '%.pdf'")).orderBy("path").collect()
    assert office[0]["error"] and office[1]["text"] == "some text"
    assert files.sqlite_samples(raw.where("path LIKE '%.db'")).count() == 100


def _drain(stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _split(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events"))
    return e


def test_token_bucket_stream_equals_fold(spark, small, tmp_path):
    e = _split(spark, small, tmp_path)
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long")
    add = lambda df: df.withColumn("tick", tick).withColumn("cost", 4 + F.col("event_id") % 9)
    got = _drain(streams.token_bucket(add(streams.read_events(spark, str(tmp_path / "events"), 10)), "user_id", "event_id", "tick", "cost", 20, 1), "append", tmp_path, "bucket")
    want = stateful.token_bucket(add(e), "user_id", "event_id", "tick", "cost", 20, 1).select("user_id", "event_id", "accepted")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_dedup_and_windows_on_a_stream(spark, small, tmp_path):
    e = _split(spark, small, tmp_path)
    s = streams.read_events(spark, str(tmp_path / "events"), 10)  # at once: later files hold earlier events, which would come late
    assert _drain(streams.deduplicated(s.union(s), "event_id"), "append", tmp_path, "dedup").count() == e.count()
    rates = _drain(streams.rolling_rates(s, "1 day", "1 day"), "complete", tmp_path, "rates")
    assert rates.agg(F.sum("n")).first()[0] == e.count()
    assert _drain(streams.sessions(s), "complete", tmp_path, "sessions").agg(F.sum("n")).first()[0] == e.count()


def test_watch_chain(spark, tmp_path):
    built = chains.build_chain(spark.createDataFrame([("a", i, f"p{i}") for i in range(6)], "chain string, seq long, payload string"))
    built.where("seq <> 3").coalesce(1).write.parquet(str(tmp_path / "lines"))
    breaks = []
    lines = spark.readStream.schema(built.schema).parquet(str(tmp_path / "lines"))
    streams.watch_chain(lines, lambda i, rows: breaks.extend(r["seq"] for r in rows.collect()), str(tmp_path / "cp")).awaitTermination()
    assert breaks == [4]
