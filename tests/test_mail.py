"""Mail headers and written dates by hand-made cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallystone.operators import mail

NOW = datetime(2030, 1, 1)


def _mails(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "k int, h string")


def test_events_and_confidence(spark):
    rows = _mails(
        spark,
        "Date: Tue, 5 Mar 2024 10:11:12 +0200\r\nReceived: from a by b;\r\n Wed, 6 Mar 2024 00:00:00 +0000\r\nReceived: x; unreadable\r\nDate: 1 Jan 2001 00:00:00 +0000",
        "date: no date",
        "X-Date: 5 Mar 2024 10:11:12 +0200",
        None,
        "",
        "Date:",
    )
    got = {tuple(r) for r in mail.header_events(rows, "k", "h", F.lit(NOW)).withColumn("at", F.col("at").cast("timestamp_ntz")).collect()}
    assert got == {
        (0, "email_sent", datetime(2024, 3, 5, 8, 11, 12), "HIGH", "Date:Tue, 5 Mar 2024 10:11:12 +0200"),
        (0, "email_received", datetime(2024, 3, 6), "MEDIUM", "Received:Wed, 6 Mar 2024 00:00:00 +0000"),
        (1, "email_sent", NOW, "LOW", "unparseable_date:no date"),
    }


def test_hops(spark):
    rows = _mails(spark, "RECEIVED: from (a) by b.example\n\twith SMTP id 7; x; Wed, 6 Mar 2024 00:00:00 +0000\nReceived:\nTo: received: from q")
    got = sorted(tuple(r)[:6] + (r["at"] is not None,) for r in mail.hops(rows, "k", "h").collect())
    assert got == [(0, 0, None, "b.example", "SMTP", "7", True), (0, 1, None, None, None, None, False)]


def test_addresses(spark):
    cases = {"A B <a@x.example>": "a@x.example", "a@x.example": "a@x.example", " a@x.example (A) ": "a@x.example", '"B, A" < a@x.example >': "a@x.example", "nobody": "nobody", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", mail.address(F.col("raw")).alias("a")).collect()
    assert {r["raw"]: r["a"] for r in rows} == cases


def test_written_dates(spark):
    text = "3/4/24, 03-04-2024; 2024/4/3 2024-04-03x 12 AVRIL 2024 1 Août 2023 5 may 99 31 december 2020. a1/2/2024 7 février 2021é 1/2/3"
    df = spark.createDataFrame([(text,), (None,), ("none",)], "t string")
    got = df.select(mail.written_dates(F.col("t")).alias("d"), mail.with_dates(F.col("t")).alias("w")).collect()
    assert got[0]["d"] == ["3/4/24", "03-04-2024", "2024/4/3", "12 AVRIL 2024", "1 Août 2023", "31 december 2020"]
    assert got[0]["w"] == text + " [dates: " + ", ".join(got[0]["d"]) + "]"
    assert (got[1]["d"], got[1]["w"], got[2]["w"]) == (None, None, "none")
