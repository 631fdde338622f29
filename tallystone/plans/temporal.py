"""Temporal queries over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import temporal as op
from tallystone.session import table


def tm_weekend(spark, sf_dir):
    return table(spark, sf_dir, "events").where(op.is_weekend(F.col("ts"))).select("event_id")


def tm_afterhours(spark, sf_dir):
    return table(spark, sf_dir, "events").where(op.is_after_hours(F.col("ts"))).select("event_id")


def _acts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "modified").otherwise("read")
    return e.select("event_id", (F.col("event_id") % 700).alias("artifact"), kind.alias("kind"), "ts")


def tm_scrubbed(spark, sf_dir):
    a = _acts(spark, sf_dir)
    return op.scrubbed(a.select("artifact").distinct(), a.where("kind = 'created' AND event_id % 3 = 0"), "artifact")


def tm_sequence(spark, sf_dir):
    return op.impossible_sequence(_acts(spark, sf_dir), "artifact").select("event_id", "artifact")


def tm_future(spark, sf_dir):
    return op.future_dated(table(spark, sf_dir, "events"), "2024-01-25 00:00:00").select("event_id")


def _dated(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("born"))
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", F.col("o_orderdate").alias("created"), "born")


def tm_backdated(spark, sf_dir):
    return op.backdated(_dated(spark, sf_dir), "born", "created").select("o_orderkey", F.col("gap_s").cast("long").alias("gap_s"))


def tm_zones(spark, sf_dir):
    z = table(spark, sf_dir, "events").withColumn("zone", F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 3).otherwise(0))
    return op.zone_conflicts(z, "user_id", "zone")


def tm_anomalies(spark, sf_dir):
    """Three kinds of findings by severity."""
    e = table(spark, sf_dir, "events")
    rows = (
        op.anomaly(op.impossible_sequence(_acts(spark, sf_dir), "artifact"), "impossible_sequence", "critical", "event_id")
        .unionByName(op.anomaly(op.future_dated(e, "2024-01-25 00:00:00"), "future_dated", "high", "event_id"))
        .unionByName(op.anomaly(e.where(op.is_weekend(F.col("ts"))), "weekend", "low", "event_id"))
    )
    return rows.groupBy("rank", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("anomaly_id").alias("first_id"))


def tm_fuse(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("log").alias("source"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("what"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("what"))
    return op.fused_timeline(e, o).withColumn("label", op.entry_label(F.col("source"), F.col("id")))


def tm_inversion(spark, sf_dir):
    return op.first_inversion(_acts(spark, sf_dir), "artifact")


def tm_duration(spark, sf_dir):
    return op.spans(table(spark, sf_dir, "events"), "user_id").withColumn("seconds", F.round("seconds", 6))


def tm_pdf_dates(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.when(i % 3 == 0, "Z").when(i % 3 == 1, "+02'30'").otherwise("-0500"))
    return table(spark, sf_dir, "events").select("event_id", op.parse_pdf_date(text).cast("timestamp_ntz").alias("at"))


def tm_mail_dates(spark, sf_dir):
    text = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.when(F.col("event_id") % 4 == 0, " +0100 (CET)").when(F.col("event_id") % 4 == 1, " -0730").otherwise(" +0000"))
    return table(spark, sf_dir, "events").select("event_id", op.parse_mail_date(F.when(F.col("event_id") % 50 == 7, "yesterday").otherwise(text)).cast("timestamp_ntz").alias("at"))


def tm_best(spark, sf_dir):
    i = F.col("o_orderkey")
    a = F.when(i % 3 == 0, "not a date").otherwise(F.when(i % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    best = op.best_timestamp(a, F.when(i % 2 == 0, "2001-02-03 04:05:06"), F.lit("1999-01-01 00:00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", best.cast("timestamp_ntz").alias("best"))


_ACTS = "a AS (SELECT event_id, event_id % 700 AS artifact, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'modified' ELSE 'read' END AS kind, ts FROM events)"
_SEQUENCE = "SELECT event_id, artifact FROM a WHERE kind = 'modified' AND ts < (SELECT max(ts) FROM a c WHERE c.artifact = a.artifact AND c.kind = 'created')"
_ID = "substr(sha256('{0}|' || event_id), 1, 16)"

QUERIES = {f.__name__: f for f in (
    tm_weekend, tm_afterhours, tm_scrubbed, tm_sequence, tm_future, tm_backdated, tm_zones, tm_anomalies, tm_fuse, tm_inversion, tm_duration, tm_pdf_dates, tm_mail_dates, tm_best,
)}

ORACLES = {
    "tm_weekend": "SELECT event_id FROM events WHERE isodow(ts) >= 6",
    "tm_afterhours": "SELECT event_id FROM events WHERE hour(ts) < 7 OR hour(ts) >= 18",
    "tm_scrubbed": f"WITH {_ACTS} SELECT DISTINCT artifact FROM a WHERE artifact NOT IN (SELECT artifact FROM a WHERE kind = 'created' AND event_id % 3 = 0)",
    "tm_sequence": f"WITH {_ACTS} {_SEQUENCE}",
    "tm_future": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25'",
    "tm_backdated": "SELECT o_orderkey, CAST(epoch(min(l_shipdate)) - epoch(any_value(o_orderdate)) AS BIGINT) AS gap_s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING epoch(min(l_shipdate)) - epoch(any_value(o_orderdate)) > 86400",
    "tm_zones": "SELECT user_id, count(DISTINCT event_id % 3) AS zones FROM events WHERE user_id % 4 = 0 GROUP BY user_id HAVING count(DISTINCT event_id % 3) > 1",
    "tm_anomalies": f"""WITH {_ACTS}, f AS (SELECT 0 AS rank, 'critical' AS severity, {_ID.format('impossible_sequence')} AS id FROM ({_SEQUENCE})
UNION ALL SELECT 1, 'high', {_ID.format('future_dated')} FROM events WHERE ts > TIMESTAMP '2024-01-25' UNION ALL SELECT 3, 'low', {_ID.format('weekend')} FROM events WHERE isodow(ts) >= 6)
SELECT rank, severity, count(*) AS n, min(id) AS first_id FROM f GROUP BY ALL""",
    "tm_fuse": """SELECT *, printf('%s-%04d', source, id) AS label FROM (SELECT 'log' AS source, event_id AS id, ts, event_type AS what FROM events WHERE event_type = 'error'
UNION ALL SELECT 'order', o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "tm_inversion": f"WITH {_ACTS} SELECT artifact, arg_min(event_id, ts) AS event_id FROM a WHERE kind = 'created' AND ts > (SELECT min(ts) FROM a m WHERE m.artifact = a.artifact AND m.kind = 'modified') GROUP BY artifact",
    "tm_duration": "SELECT user_id, min(ts) AS earliest, max(ts) AS latest, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM events GROUP BY user_id",
    "tm_pdf_dates": "SELECT event_id, date_trunc('second', ts) - to_minutes(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 150 ELSE -300 END) AS at FROM events",
    "tm_mail_dates": "SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN date_trunc('second', ts) - to_minutes(CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN -450 ELSE 0 END) END AS at FROM events",
    "tm_best": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2001-02-03 04:05:06' ELSE TIMESTAMP '1999-01-01' END AS best FROM orders",
}
