"""Telemetry queries over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import telemetry as op
from tallystone.session import table

FAMILIES = {"error": "retrieval", "click": "compression", "view": "compression"}


def _runs(spark, sf_dir):
    """Each order is a run: its line items are stations, the order is the outcome."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit("station").alias("kind"), (F.col("l_partkey") % 900).alias("tokens"), (F.col("l_suppkey") * 120).alias("ms"), F.lit(None).cast("boolean").alias("ok"), F.when(F.col("l_partkey") % 5 != 0, F.array(F.lit(True), F.col("l_partkey") % 97 != 1, F.lit(True), F.lit(None).cast("boolean"))).alias("checks"))
    outs = o.where("o_orderkey % 50 <> 3").select(F.col("o_orderkey").alias("run_id"), F.lit(100).cast("long").alias("seq"), F.lit("outcome").alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 4000).cast("long").alias("tokens"), F.lit(0).cast("long").alias("ms"), (F.col("o_orderkey") % 40 != 0).alias("ok"))
    return op.assemble_runs(parts.unionByName(outs, allowMissingColumns=True))


def _bucketed(spark, sf_dir):
    return _runs(spark, sf_dir).where("n_outcomes > 0").withColumn("bucket", op.run_bucket()).withColumn("tokens", op.total_tokens())


def tl_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", op.total_tokens().alias("tokens"), "n_stations", (F.col("n_outcomes") == 0).alias("incomplete"))


def tl_buckets(spark, sf_dir):
    return _bucketed(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), F.count_if(~F.col("ok")).alias("failed"))


def tl_percentiles(spark, sf_dir):
    return op.exact_ranks(_bucketed(spark, sf_dir), "tokens", "bucket")


def tl_diff(spark, sf_dir):
    b = _bucketed(spark, sf_dir)
    return op.bucket_diff(b.where("run_id % 2 = 0").groupBy("bucket").count(), b.where("run_id % 2 = 1").groupBy("bucket").count())


def tl_families(spark, sf_dir):
    return op.with_family(table(spark, sf_dir, "events"), FAMILIES, "event_type").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def tl_weekly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("synthetic", F.col("user_id") % 10 == 0).withColumn("blocked", F.col("event_type") == "error")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"), F.round(F.avg(F.col("blocked").cast("int")), 6).alias("rate"))


def tl_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.grouping_id().cast("long").alias("level"))


def tl_cube(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("grade", F.when(F.col("p_size") < 10, "A").when(F.col("p_size") < 30, "B").otherwise("C"))
    return p.cube("p_type", "grade").agg(F.count(F.lit(1)).alias("n"))


def tl_decision(spark, sf_dir):
    e = op.with_family(table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00'"), FAMILIES, "event_type")
    return op.decision(e.groupBy("family").agg(F.count(F.lit(1)).alias("n")))


def tl_rolling(spark, sf_dir):
    e = op.trailing(table(spark, sf_dir, "events"), "2024-01-20 00:00:00", 86400)
    ok = F.col("event_type") != "error"
    return e.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / 86400.0, 6).alias("rate"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.percentile(F.when(ok, F.col("value")), 0.5), 2).alias("p50"), F.round(F.percentile(F.when(ok, F.col("value")), 0.95), 2).alias("p95"), F.round(F.avg((~ok).cast("int")), 6).alias("error_rate"),
    )


def tl_rolling_each(spark, sf_dir):
    """For every event the number of its user's events in the 6 hours up to it."""
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM {e}", e=table(spark, sf_dir, "events"))


def tl_last_n(spark, sf_dir):
    return op.latest_n(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 10).withColumn("mean", F.round("mean", 6))


def tl_newest_buffer(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


def tl_trimmed_median(spark, sf_dir):
    return op.trimmed_median(table(spark, sf_dir, "events"), "event_type", "value", 1.5).withColumn("median", F.round("median", 6))


def tl_signals(spark, sf_dir):
    e = op.latest_signals(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", "value", "2024-01-31 00:00:00", 200_000)
    return op.trimmed_median(e, "event_type", "value", 1.0).withColumn("median", F.round("median", 6))


def tl_before_after(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("phase", F.when(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz"), "before").otherwise("after"))
    out = op.before_after(o.withColumn("price", F.round(F.col("o_totalprice") * 100).cast("long")), "o_orderpriority", "phase", "price")
    return out.select("o_orderpriority", "n_before", "n_after", F.round("delta", 3).alias("delta"), F.round("percent", 4).alias("percent"))


def tl_capacity(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("s_acctbal"), 2).alias("capacity"))


def tl_escalation(spark, sf_dir):
    counts = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))
    return op.escalation(counts, [("watch", 5), ("warn", 12), ("act", 18)], "errors")


def tl_strata(spark, sf_dir):
    """Quarters: of each customer's orders in a quarter the last is kept; kept against all."""
    o = table(spark, sf_dir, "orders").withColumn("q", F.concat_ws("Q", F.year("o_orderdate"), F.quarter("o_orderdate")))
    last = o.groupBy("q", "o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.count(F.lit(1)).alias("n"))
    return last.groupBy("q").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all"), F.count_if(F.col("status") == "O").alias("open")).withColumn("ratio", F.round(F.col("kept") / F.col("all"), 6))


def tl_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    return op.queue_depth(e.select(status.alias("status"), F.col("event_id").alias("created")))


def tl_epochs(spark, sf_dir):
    """Admission by day: accepted and rejected, share accepted, busiest user."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 20).alias("ok"))
    return e.groupBy("epoch").agg(F.sum("ok").alias("accepted"), F.sum(F.col("n") - F.col("ok")).alias("rejected"), F.max_by("user_id", F.struct("n", "user_id")).alias("busiest")).withColumn("share", F.round(F.try_divide(F.col("accepted"), F.col("accepted") + F.col("rejected")), 6))


def tl_extraction_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("mails", F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.size("mails") > 0).alias("with_mail"), F.sum(F.greatest(F.size("mails"), F.lit(0))).alias("mails"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


def tl_replay_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return op.positional_diff(e, e.where("event_id % 700 <> 9").withColumn("user_id", F.when(F.col("event_id") % 300 == 8, -1).otherwise(F.col("user_id")).cast("long")), "event_id", ["event_type", "user_id"])


def tl_compress_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") <= 2000).alias("passes"))


_RUNS = """WITH parts AS (SELECT l_orderkey AS run_id, sum(l_partkey % 900) AS parts_total, count(*) AS n_stations, max(l_suppkey * 120) AS max_ms, bool_or(l_partkey % 5 <> 0 AND l_partkey % 97 = 1) AS m_failed FROM lineitem GROUP BY 1),
outs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 4000 END AS total, o_orderkey % 40 <> 0 AS ok FROM orders WHERE o_orderkey % 50 <> 3),
runs AS (SELECT run_id, CAST(CASE WHEN coalesce(total, 0) <> 0 THEN total ELSE coalesce(parts_total, 0) END AS BIGINT) AS tokens, coalesce(n_stations, 0) AS n_stations, coalesce(max_ms, 0) AS ms, ok, total IS NULL AS incomplete, coalesce(m_failed, false) AS m_failed FROM parts FULL JOIN outs USING (run_id)),
b AS (SELECT *, CASE WHEN m_failed OR NOT ok OR ms > 30000 OR tokens > 8000 THEN 'heavy' WHEN n_stations <= 1 AND tokens <= 500 THEN 'trivial' WHEN n_stations <= 2 AND tokens <= 2000 AND ms <= 5000 THEN 'micro_solvable' ELSE 'structured_final' END AS bucket FROM runs WHERE NOT incomplete)"""
_FAMILY = "CASE event_type WHEN 'error' THEN 'retrieval' WHEN 'click' THEN 'compression' WHEN 'view' THEN 'compression' ELSE 'other' END"
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"

QUERIES = {f.__name__: f for f in (
    tl_runs, tl_buckets, tl_percentiles, tl_diff, tl_families, tl_weekly, tl_rollup, tl_cube, tl_decision, tl_rolling, tl_rolling_each, tl_last_n, tl_newest_buffer, tl_trimmed_median, tl_signals, tl_before_after, tl_capacity, tl_escalation, tl_strata, tl_queue, tl_epochs, tl_extraction_summary, tl_replay_diff, tl_compress_gate,
)}

ORACLES = {
    "tl_runs": f"{_RUNS} SELECT run_id, tokens, n_stations, incomplete FROM runs",
    "tl_buckets": f"{_RUNS} SELECT bucket, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE NOT ok) AS failed FROM b GROUP BY bucket",
    "tl_percentiles": f"{_RUNS} SELECT bucket, count(*) AS n, median(tokens) AS p50, list_sort(list(tokens))[least(count(*), CAST(floor(count(*) * 0.95e0) AS BIGINT) + 1)] AS p95, max(tokens) AS max FROM b GROUP BY bucket",
    "tl_diff": f"{_RUNS} SELECT bucket, count(run_id) FILTER (WHERE run_id % 2 = 0) AS a, count(run_id) FILTER (WHERE run_id % 2 = 1) AS b, count(run_id) FILTER (WHERE run_id % 2 = 1) - count(run_id) FILTER (WHERE run_id % 2 = 0) AS diff FROM (SELECT unnest(['trivial', 'micro_solvable', 'structured_final', 'heavy']) AS bucket) LEFT JOIN b USING (bucket) GROUP BY bucket",
    "tl_families": f"SELECT {_FAMILY} AS family, count(*) AS n FROM events GROUP BY 1",
    "tl_weekly": "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 10 = 0 AS synthetic, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS blocked, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS rate FROM events GROUP BY ALL",
    "tl_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "tl_cube": "WITH p AS (SELECT p_type, CASE WHEN p_size < 10 THEN 'A' WHEN p_size < 30 THEN 'B' ELSE 'C' END AS grade FROM part) SELECT p_type, grade, count(*) AS n FROM p GROUP BY CUBE (p_type, grade)",
    "tl_decision": f"""WITH f AS (SELECT {_FAMILY} AS family FROM events WHERE ts >= TIMESTAMP '2024-01-05'),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE family = 'retrieval') AS retrieval, count(*) FILTER (WHERE family = 'compression') AS compression FROM f)
SELECT *, CASE WHEN total < 20 THEN 'UNDERPOWERED' WHEN retrieval > 0 AND retrieval * 2 >= total THEN 'PHASE_4' WHEN compression > 0 AND compression * 2 >= total THEN 'PHASE_5' ELSE 'LINE_HEALTHY' END AS verdict FROM t""",
    "tl_rolling": """SELECT count(*) AS n, round(count(*) / 86400e0, 6) AS rate, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 2) AS p50,
round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 2) AS p95, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS error_rate FROM events WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20'""",
    "tl_rolling_each": "SELECT event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.ts BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts) AS n FROM events e",
    "tl_last_n": "WITH r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_max(value, event_id) AS latest FROM r GROUP BY user_id",
    "tl_newest_buffer": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "tl_trimmed_median": "WITH s AS (SELECT event_type, median(value) AS m, stddev_samp(value) AS d FROM events GROUP BY 1) SELECT event_type, round(median(value), 6) AS median, count(*) AS n FROM events JOIN s USING (event_type) WHERE d IS NULL OR d = 0 OR abs(value - m) <= 1.5 * d GROUP BY 1",
    "tl_signals": """WITH l AS (SELECT event_type, user_id, max({'t': ts, 'v': value}) AS x FROM events GROUP BY 1, 2), e AS (SELECT event_type, x.v AS value FROM l WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(x.t) <= 200000000000),
s AS (SELECT event_type, median(value) AS m, stddev_samp(value) AS d FROM e GROUP BY 1) SELECT event_type, round(median(value), 6) AS median, count(*) AS n FROM e JOIN s USING (event_type) WHERE d IS NULL OR d = 0 OR abs(value - m) <= 1.0 * d GROUP BY 1""",
    "tl_before_after": """WITH o AS (SELECT o_orderpriority, o_orderdate < TIMESTAMP '1998-07-01' AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
g AS (SELECT o_orderpriority, count(*) FILTER (WHERE b) AS n_before, count(*) FILTER (WHERE NOT b) AS n_after, avg(price) FILTER (WHERE b) AS x, avg(price) FILTER (WHERE NOT b) AS y FROM o GROUP BY 1)
SELECT o_orderpriority, n_before, n_after, round(y - x, 3) AS delta, round((y - x) * 100 / x, 4) AS percent FROM g""",
    "tl_capacity": "SELECT s_nationkey, count(*) AS nodes, round(sum(s_acctbal), 2) AS capacity FROM supplier GROUP BY 1",
    "tl_escalation": "SELECT user_id, count(*) AS errors, CASE WHEN count(*) >= 18 THEN 'act' WHEN count(*) >= 12 THEN 'warn' WHEN count(*) >= 5 THEN 'watch' END AS level FROM events WHERE event_type = 'error' GROUP BY user_id",
    "tl_strata": """WITH l AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q, o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, count(*) AS n FROM orders GROUP BY ALL)
SELECT q, count(*) AS kept, CAST(sum(n) AS BIGINT) AS all, count(*) FILTER (WHERE status = 'O') AS open, round(count(*) / sum(n), 6) AS ratio FROM l GROUP BY q""",
    "tl_queue": "SELECT count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'click') AS running, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'error')) AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, coalesce(min(event_id) FILTER (WHERE event_type = 'view'), 0) AS oldest_pending FROM events",
    "tl_epochs": """WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS epoch, user_id, count(*) AS n, count(*) FILTER (WHERE value >= 20) AS ok FROM events GROUP BY ALL)
SELECT epoch, CAST(sum(ok) AS BIGINT) AS accepted, CAST(sum(n - ok) AS BIGINT) AS rejected, (SELECT o.user_id FROM u o WHERE o.epoch = u.epoch ORDER BY n DESC, user_id DESC LIMIT 1) AS busiest, round(sum(ok) / sum(n), 6) AS share FROM u GROUP BY epoch""",
    "tl_extraction_summary": f"""WITH d AS (SELECT source, n_chars, len(regexp_extract_all(coalesce(text, ''), '{_MAIL}')) AS m FROM documents)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE m > 0) AS with_mail, CAST(sum(m) AS BIGINT) AS mails, min(n_chars) AS shortest, max(n_chars) AS longest FROM d GROUP BY source""",
    "tl_replay_diff": "SELECT event_id, CASE WHEN event_id % 700 = 9 THEN 'event_type,user_id' ELSE 'user_id' END AS fields FROM events WHERE event_id % 700 = 9 OR event_id % 300 = 8 ORDER BY event_id LIMIT 10",
    "tl_compress_gate": "SELECT doc_id, length(text) <= 2000 AS passes FROM documents",
}
