"""Queries on mail headers and written dates, beside their SQL. Headers are written from ``conversations`` by the same rule in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import mail as op
from tallystone.session import table


def _c(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _mails(spark, sf_dir):
    k = F.col("key")
    date = F.when(k % 9 == 4, "some day").otherwise(_text(1 + k % 28, " Mar 2024 10:", F.lpad((k % 60).cast("string"), 2, "0"), ":00 +0000"))
    first = _text("Received: from a", k % 5, ".example (helo [10.0.0.1])\n\tby b.example with ESMTP id q", k, "; Mon, ", 1 + k % 28, " Apr 2024 01:02:03 -0500 (EST)\n")
    second = F.when(k % 4 == 1, _text("Received: by c.example; odd\n")).when(k % 4 == 2, "Received: from (unknown) by d.example\n").otherwise("")
    return _c(spark, sf_dir).select("key", _text("From: N <n", k % 7, "@x.example>\nReceived-By: none\n", first, second, F.when(k % 8 == 3, "").otherwise(_text("DATE: ", date, "\n")), "Subject: s").alias("headers"))


def tm_header_events(spark, sf_dir):
    found = op.header_events(_mails(spark, sf_dir), "key", "headers", F.timestamp_seconds(F.lit(1_700_000_000)))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


def en_hop_parts(spark, sf_dir):
    return op.hops(_mails(spark, sf_dir), "key", "headers").withColumn("at", F.col("at").cast("timestamp_ntz"))


def en_senders(spark, sf_dir):
    sender = op.address(op.header(F.col("headers"), "From"))
    return _mails(spark, sf_dir).groupBy(sender.alias("sender")).agg(F.count(F.lit(1)).alias("n"))


def cl_written_dates(spark, sf_dir):
    k, n = F.col("key"), F.length("text")
    month = F.element_at(F.array(*map(F.lit, ("avril", "AOÛT", "December", "smarch"))), (k % 4 + 1).cast("int"))
    text = _text("On ", 1 + n % 28, " ", month, " 2023, ", n % 12, "/", k % 30, "/24 and 2024-", n % 10, "-", k % 28, "x ended 12-", 1 + k % 12, "-2024.")
    return _c(spark, sf_dir).select("key", op.with_dates(text).alias("claim"))


QUERIES = {f.__name__: f for f in (tm_header_events, en_hop_parts, en_senders, cl_written_dates)}

_C = "c AS (SELECT conv_id * 1000 + turn AS key, length(text) AS n FROM conversations)"
_RECEIVED = "TIMESTAMP '2024-04-01 06:02:03' + to_days(CAST(key % 28 AS INTEGER))"

ORACLES = {
    "tm_header_events": f"""WITH {_C} SELECT key, 'email_sent' AS event, CASE WHEN key % 9 = 4 THEN TIMESTAMP '2023-11-14 22:13:20' ELSE TIMESTAMP '2024-03-01 10:00:00' + to_days(CAST(key % 28 AS INTEGER)) + to_minutes(key % 60) END AS at,
  CASE WHEN key % 9 = 4 THEN 'LOW' ELSE 'HIGH' END AS confidence, CASE WHEN key % 9 = 4 THEN 'unparseable_date:some day' ELSE 'Date:' || 1 + key % 28 || ' Mar 2024 10:' || lpad((key % 60)::VARCHAR, 2, '0') || ':00 +0000' END AS artifact FROM c WHERE key % 8 <> 3
UNION ALL SELECT key, 'email_received', {_RECEIVED}, 'MEDIUM', 'Received:Mon, ' || 1 + key % 28 || ' Apr 2024 01:02:03 -0500 (EST)' FROM c""",
    "en_hop_parts": f"""WITH {_C} SELECT key, 0 AS hop, 'a' || key % 5 || '.example' AS from_host, 'b.example' AS by_host, 'ESMTP' AS protocol, 'q' || key AS id, {_RECEIVED} AS at FROM c
UNION ALL SELECT key, 1, NULL, CASE WHEN key % 4 = 1 THEN 'c.example' ELSE 'd.example' END, NULL, NULL, NULL FROM c WHERE key % 4 IN (1, 2)""",
    "en_senders": f"WITH {_C} SELECT 'n' || key % 7 || '@x.example' AS sender, count(*) AS n FROM c GROUP BY 1",
    "cl_written_dates": f"""WITH {_C}, t AS (SELECT key, CASE WHEN key % 4 < 3 THEN 1 + n % 28 || ' ' || ['avril', 'AOÛT', 'December'][key % 4 + 1] || ' 2023' END AS a, n % 12 || '/' || key % 30 || '/24' AS b, '12-' || 1 + key % 12 || '-2024' AS d,
  'On ' || 1 + n % 28 || ' ' || ['avril', 'AOÛT', 'December', 'smarch'][key % 4 + 1] || ' 2023, ' || n % 12 || '/' || key % 30 || '/24 and 2024-' || n % 10 || '-' || key % 28 || 'x ended 12-' || 1 + key % 12 || '-2024.' AS text FROM c)
SELECT key, text || ' [dates: ' || concat_ws(', ', a, b, d) || ']' AS claim FROM t""",
}
