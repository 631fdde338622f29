"""Sources and sinks: chain lines, typed readers, folders of files, mail, office files, SQLite samples, reports.

Paths are handed to Spark's readers; files that need a parser come through ``binaryFile``, one row a file, and are
parsed where they are read.
"""

from __future__ import annotations

import csv
import email
import io
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from email import policy
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN_SCHEMA = "ts_ns long, engine string, event string, payload string, prev_hash string, sig string"


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL chains with their text, the file and their order in it; lines that are not JSON have null fields.

    Order within a file is the line's byte position, which whole-file reading keeps apart from how files are split.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("chain"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    rows = files.where(F.col("line") != "")
    # The payload may be any JSON value: it stays text.
    parsed = F.from_json("line", CHAIN_SCHEMA)
    return rows.select("chain", F.col("seq").cast("long").alias("seq"), "line", parsed.alias("e")).select("chain", "seq", "line", "e.*")


def append_chain(lines: DataFrame, path: str) -> None:
    """Append lines (column line), in order of chain and seq, one file a chain and write."""
    lines.repartition("chain").sortWithinPartitions("chain", "seq").select("chain", "line").write.mode("append").partitionBy("chain").text(path)


def read_daily(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(glob)


def kind_of(content: Column) -> Column:
    """The container's kind by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png")
        .when(head.startswith("53514C69"), "sqlite").when(head.startswith("D0CF11E0"), "ole").otherwise("text")
    )


def walk(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder: path, length, modified, sha256, kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), kind_of(F.col("content")).alias("kind"))


def _per_file(files: DataFrame, parse, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse(bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def mail_planes(files: DataFrame) -> DataFrame:
    """Header and body of mail files (path, content): sender, recipients, subject, date as text, hops, attachments, body."""

    def parse(content: bytes) -> list[tuple]:
        m = email.message_from_bytes(content, policy=policy.default)
        body = m.get_body(("plain", "html"))
        names = ",".join(a.get_filename() or "" for a in m.iter_attachments())
        hops = len(m.get_all("Received", []))
        return [(str(m["From"] or ""), str(m["To"] or ""), str(m["Subject"] or ""), str(m["Date"] or ""), hops, names, body.get_content() if body else "")]

    return _per_file(files, parse, "path string, sender string, recipients string, subject string, date string, hops int, attachments string, body string")


def office_planes(files: DataFrame) -> DataFrame:
    """Properties and text of zipped office files; broken files give a row with an error."""

    def parse(content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                props = {}
                if "docProps/core.xml" in names:
                    props = {e.tag.rpartition("}")[2]: e.text for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
                main = next((n for n in ("word/document.xml", "content.xml") if n in names), None)
                text = " ".join(t.strip() for t in ElementTree.fromstring(z.read(main)).itertext() if t.strip()) if main else ""
                return [(props.get("creator"), props.get("created"), props.get("modified"), len(names), text, None)]
        except (zipfile.BadZipFile, ElementTree.ParseError) as e:
            return [(None, None, None, 0, None, str(e))]

    return _per_file(files, parse, "path string, creator string, created string, modified string, parts int, text string, error string")


def sqlite_samples(files: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of every table of SQLite files: path, table, n, row (values as text, joined by tabs)."""

    def parse(content: bytes) -> list[tuple]:
        out = []
        with tempfile.NamedTemporaryFile(suffix=".db") as f:
            f.write(content)
            f.flush()
            con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
            for (name,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                quoted = name.replace('"', '""')
                out += [(name, i, "\t".join("" if v is None else str(v) for v in r)) for i, r in enumerate(con.execute(f'SELECT * FROM "{quoted}" LIMIT {int(rows)}'))]
            con.close()
        return out

    return _per_file(files, parse, "path string, table string, n int, row string")


def csv_samples(files: DataFrame, rows: int = 5_000) -> DataFrame:
    """The first rows of CSV files: path, n, cells. Bytes that are no UTF-8 are replaced; an empty or broken file gives what was read."""

    def parse(content: bytes) -> list[tuple]:
        out: list[tuple] = []
        reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding="utf-8", errors="replace", newline=""))
        try:
            out += [(i, cells) for i, cells in enumerate(islice(reader, rows))]
        except csv.Error:
            pass
        return out

    return _per_file(files, parse, "path string, n int, cells array<string>")


def tail(lines: DataFrame, n: int, level: str | None = None, source: str | None = None) -> DataFrame:
    """The newest n log rows (ts, level, source, message) of a level and source."""
    for column, value in (("level", level), ("source", source)):
        if value is not None:
            lines = lines.where(F.col(column) == value)
    return lines.orderBy(F.desc("ts")).limit(n)


def subject_columns(subject: Column, *names: str) -> list[Column]:
    """The dotted parts of a message's subject as columns."""
    parts = F.split(subject, r"\.")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def write_report(rows: DataFrame, path: str) -> None:
    """A report's sections as JSON files, partitioned by section."""
    rows.write.mode("overwrite").partitionBy("section").json(path)
