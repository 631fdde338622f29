"""Queries over registers, planes, checkpoints and witnessed chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import chains, compliance, registers, stateful, telemetry, temporal
from tallystone.plans import chains as chain_plans
from tallystone.plans import stateful as state_plans
from tallystone.plans import telemetry as telemetry_plans
from tallystone.session import table


def _reports(spark, sf_dir):
    """Every third event is a report of a case; some reports have no manifest."""
    i = F.col("event_id")
    payload = F.struct(
        F.concat(F.lit("v"), i).alias("version_id"), F.concat(F.lit("case-"), F.col("user_id")).alias("case_id"), F.when(i % 5 != 0, F.sha2(F.col("props"), 256)).alias("report_hash"),
        F.concat(F.lit("m"), i % 40).alias("manifest_fingerprint"), F.when(i % 4 != 0, F.concat(F.lit("manifest "), i)).alias("manifest"),
    )
    return table(spark, sf_dir, "events").select(i.alias("seq"), F.when(i % 2 == 0, "rfe").otherwise("core").alias("engine"), F.when(i % 3 == 0, "report_generated").otherwise("started").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ns"), payload.alias("payload"))


def fu_versions(spark, sf_dir):
    return registers.report_versions(_reports(spark, sf_dir), "case-7").select("seq", "version_id", "case_id", "report_hash", "timestamp_ns")


def fu_manifest(spark, sf_dir):
    return registers.manifests_by_fingerprint(_reports(spark, sf_dir), spark.range(30).select(F.concat(F.lit("m"), "id").alias("fingerprint")))


def fu_cell_streams(spark, sf_dir):
    i = F.col("event_id")
    cells = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cell"), i % 50).alias("cell_id"), F.concat_ws("/", F.lit("root"), F.col("event_type"), F.when(i % 2 == 0, "").otherwise("leaf")).alias("taxonomy"), F.when(i % 3 == 0, "PASS").when(i % 3 == 1, "FAIL").otherwise("OTHER").alias("verdict"),
        F.col("props").alias("final_output"), (1 + i % 5).cast("int").alias("tier"), ((i % 100) / 100.0).alias("confidence"), F.sha2(i.cast("string"), 256).alias("provenance_hash"), "ts",
    )
    out = registers.cell_streams(cells, {"PASS": "positive", "FAIL": "negative"})
    return out.select("stream_id", "claim", "subject", "source_tier", "severity_impact", F.array_join("relevance_tags", ",").alias("tags"))


def en_planes(spark, sf_dir):
    k = F.col("c_custkey")
    container = F.struct(F.when(k % 3 == 0, F.concat(F.lit("A"), k, F.lit("+x@Example.com"))).alias("from_addr"), F.when(k % 4 == 0, F.array(F.concat(F.lit("b"), k, F.lit("@d.org")))).alias("to_addrs"), F.lit(None).cast("array<string>").alias("cc_addrs"), F.array().cast("array<string>").alias("bcc_addrs"))
    app = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("Dr. Person "), k % 9)).alias("author"), F.concat(F.lit("Writer "), k % 4, F.lit(".1")).alias("producer"), F.lit("").alias("creator"), F.when(k % 5 == 0, F.concat(F.lit("Firm"), k % 7, F.lit(" GmbH"))).alias("company"),
        F.lit(None).cast("string").alias("last_modified_by"), F.lit(None).cast("string").alias("manager"), F.when(k % 6 == 0, F.concat(F.lit("\\\\SRV"), k % 5, F.lit("\\share\\t.dot"))).when(k % 6 == 1, F.lit("C:\\t.dot")).alias("template"),
    )
    content = F.struct(F.array().cast("array<string>").alias("email_addresses"), F.array(F.concat(F.lit("10.0.0."), k % 200)).alias("ip_addresses"), F.when(k % 8 == 0, F.array(F.lit("aa-bb-cc-00-11-22"))).alias("mac_addresses"), F.array(F.lit("+49 30 1")).alias("phone_numbers"))
    artifacts = table(spark, sf_dir, "customer").select(k.alias("artifact"), container.alias("container"), app.alias("app"), content.alias("content"))
    return registers.plane_entities(artifacts).select("artifact", "kind", "form", "field")


def tl_trend(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("lane"), "o_orderkey", (F.col("o_orderkey") % 110).alias("tu_allocated"), (F.col("o_orderkey") % 37).alias("submitted"))
    return registers.pressure_trend(o, "lane", "o_orderkey", 100, 100).select("lane", "epochs", F.round("avg_util", 6).alias("avg_util"), F.round("avg_backlog", 6).alias("avg_backlog"), "recommendation")


def tl_registry(spark, sf_dir):
    k = F.col("p_partkey")
    return registers.registry_health(table(spark, sf_dir, "part").select(F.when(k % 3 == 0, "RUNNING").when(k % 50 == 1, "ERROR").otherwise("STOPPED").alias("status")))


def tl_bucket_stations(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("station"))
    return registers.bucket_members(telemetry_plans._bucketed(spark, sf_dir), parts, "station")


def tm_pdf_anomalies(spark, sf_dir):
    return temporal.instant_anomalies(table(spark, sf_dir, "events"), "event_id", "ts", "pdf_info", "2024-01-25 00:00:00").select("subject", "kind", "severity", "confidence")


def ru_composed(spark, sf_dir):
    i = F.col("event_id")
    nodes = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.array(F.concat(F.lit("f"), i % 7), F.concat(F.lit("f"), i % 4)).alias("premises"), F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("low; r"), i % 5)).alias("uncertainty")
    )
    return compliance.composed(nodes, "user_id", "event_id").select("user_id", F.array_join("evidence", ",").alias("evidence"), F.array_join("flags", ",").alias("flags"))


def ru_policy_route(spark, sf_dir):
    i = F.col("event_id")
    level = F.when(i % 5 == 0, "Strict").when(i % 5 == 1, "REVIEW").when(i % 5 == 2, "quarantine").when(i % 5 == 3, "open")
    return table(spark, sf_dir, "events").select("event_id", compliance.policy_route(level).alias("route"))


def ru_compliance(spark, sf_dir):
    k = F.col("p_partkey")
    projections = table(spark, sf_dir, "part").select(
        F.when(k % 11 != 0, k.cast("string")).alias("projection_id"), k.alias("part"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"))).alias("bindings"), F.concat(F.lit("p"), k % 4).alias("policy_id"), (k % 9).alias("depth"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("fields"),
    )
    policies = spark.createDataFrame([("p0", 5, None), ("p1", None, ["a", "b"]), ("p2", 3, ["c"])], "policy_id string, max_depth int, required array<string>")
    return compliance.compliance(projections, policies).select("part", "status", F.array_join("violations", ",").alias("violations"))


def _operations(spark, sf_dir):
    i = F.col("event_id")
    ops = table(spark, sf_dir, "events").select(
        i.alias("op"), F.array(F.concat(F.lit("port"), i % 13)).alias("required"), F.when(i % 2 == 0, F.concat(F.lit("pr"), i % 5)).alias("projection"), F.concat(F.lit("/"), i % 3).alias("path"), F.lit("s").alias("scope"),
        F.array(F.when(i % 17 == 0, "x:TERMINAL").otherwise("x")).alias("inputs"), F.when(i % 3 != 0, F.sha2((i % 6).cast("string"), 256)).alias("spec_hash"), F.sha2((i % 4).cast("string"), 256).alias("runtime_hash"),
    )
    scopes = spark.range(15).select(F.concat(F.lit("pr"), F.col("id") % 5).alias("projection"), F.concat(F.lit("/"), F.col("id") % 3).alias("path"), F.lit("s").alias("scope")).where("NOT (projection = 'pr4' AND path = '/1')")
    return compliance.checkpoints(ops, spark.range(12).select(F.concat(F.lit("port"), "id").alias("port")), scopes)


def ru_checkpoints(spark, sf_dir):
    return _operations(spark, sf_dir).select("op", "blocked")


def tl_audit_counts(spark, sf_dir):
    return compliance.audit_counts(_operations(spark, sf_dir))


def ch_block_checks(spark, sf_dir):
    """Blocks of which some lost a record, some a count, some were linked to another after they were made."""
    t, b = F.col("tenant"), F.col("block")
    records = chain_plans._records(spark, sf_dir)
    made = chains.block_chain(chains.merkle_roots(records, "tenant", "block"), "tenant")
    integrity = chains.stable_id(t, b, F.col("previous"), F.col("root"), F.col("n_records"))
    sealed = made.select("tenant", "block", F.lit("").alias("_"), F.col("n_records").alias("record_count"), F.col("root").alias("merkle_root"), integrity.alias("integrity_hash"), "previous")
    linked = chains.with_previous(sealed.drop("previous"), "tenant", "block", "integrity_hash").withColumn("previous", F.coalesce("previous.integrity_hash", F.lit(chains.GENESIS)))
    resealed = linked.withColumn("integrity_hash", F.when((t % 7 == 0) & (b == 1), F.sha2("integrity_hash", 256)).otherwise(F.col("integrity_hash")))
    counted = resealed.withColumn("record_count", F.when((t % 5 == 0) & (b == 2), F.lit(3)).when(t % 9 == 0, F.lit(0)).otherwise(F.col("record_count")))
    return chains.block_checks(counted, records.where("NOT (tenant % 6 = 0 AND block = 1 AND slot = 4)"), "tenant")


def ch_witness(spark, sf_dir):
    records = chain_plans._records(spark, sf_dir).select("tenant", (F.col("block") * 20 + F.col("slot")).alias("pos"), "h")
    return chains.witness_checkpoints(records, "tenant", 1_700_000_000).select("tenant", "entries", "head", "root", "checkpoint_id")


def _ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 50).alias("tokens"))
    return chains.build_ledger(e, ["event", "seq", "tokens"])


def ch_ledger(spark, sf_dir):
    """First faults after some entries were edited, some removed and some lost their hash."""
    i = F.col("seq")
    edited = _ledger(spark, sf_dir).where("seq % 83 <> 7").withColumn("tokens", F.when(i % 61 == 5, 99).otherwise(F.col("tokens"))).withColumn("hash", F.when(i % 131 != 3, F.col("hash")))
    return chains.ledger_faults(edited, ["event", "seq", "tokens"])


def cl_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact"))
    i = F.col("event_id")
    findings = table(spark, sf_dir, "events").select(i.alias("finding"), F.col("event_type").alias("kind"), F.array(i % 150, (i * 7) % 90, i % 150).alias("affected"))
    out = registers.with_findings(d, findings)
    return out.select("artifact", F.size("findings").cast("long").alias("n"), F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["finding"].cast("string"), x["kind"])), ",").alias("findings"))


def tl_policies(spark, sf_dir):
    i = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(
        (i % 7).alias("policy"), (F.col("user_id") % 10 == 0).alias("synthetic"), (F.col("event_type") == "error").alias("blocked"), F.when(i % 3 != 0, F.array(F.concat(F.lit("k"), i % 4), F.concat(F.lit("k"), i % 5))).alias("violations")
    )
    return registers.policy_report(runs, {"k0": "retrieval", "k1": "compression", "k2": "retrieval"}).withColumn("rate", F.round("rate", 6))


def tl_critic_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.col("value") * 10).alias("latency"))
    return telemetry.exact_ranks(e, "latency", "day")


def st_top_gear(spark, sf_dir):
    geared = stateful.gear(state_plans._ticks(spark, sf_dir).withColumn("load", (F.col("event_id") * 37 % 100) / 100.0), "user_id", "event_id", "tick", "load", cooldown=12)
    return stateful.top_gear_events(geared, 4, "event_id").select("event_id", "gear", "ts_hex")


QUERIES = {f.__name__: f for f in (
    fu_versions, fu_manifest, fu_cell_streams, en_planes, tl_trend, tl_registry, tl_bucket_stations, tl_audit_counts, tm_pdf_anomalies, ru_composed, ru_policy_route, ru_compliance, ru_checkpoints, ch_block_checks, ch_witness, ch_ledger, cl_findings, tl_policies, tl_critic_days, st_top_gear,
)}

_OPS = """o AS (SELECT event_id AS i, event_id % 13 = 12 AS m2, event_id % 2 = 0 AND event_id % 5 = 4 AND event_id % 3 = 1 AS m1, event_id % 17 = 0 AS m3, event_id % 3 <> 0 AS spec, event_id % 6 <> event_id % 4 AS m4 FROM events),
c AS (SELECT *, CASE WHEN m2 THEN 'M2' WHEN m1 THEN 'M1' WHEN m3 THEN 'M3' WHEN spec AND m4 THEN 'M4' END AS blocked FROM o)"""
_WHOLE_TREE = """, n AS (SELECT tenant, count(*) AS entries, arg_max(h, block * 20 + slot) AS head FROM rec GROUP BY tenant), tree AS (
  SELECT tenant, 0 AS depth, block * 20 + slot AS pos, sha256('\\x00'::BLOB || h::BLOB) AS h, entries AS size FROM rec JOIN n USING (tenant)
  UNION ALL
  SELECT tenant, depth + 1, pos // 2, sha256(min(h) || max(h)), any_value((size + 1) // 2) FROM tree WHERE size > 1 GROUP BY tenant, depth, pos // 2
)"""

ORACLES = {
    "fu_versions": "SELECT event_id AS seq, 'v' || event_id AS version_id, 'case-' || user_id AS case_id, CASE WHEN event_id % 5 <> 0 THEN sha256(props) ELSE '' END AS report_hash, epoch_us(ts) AS timestamp_ns FROM events WHERE event_id % 6 = 0 AND user_id = 7",
    "fu_manifest": "SELECT 'm' || event_id % 40 AS fingerprint, min(event_id) AS seq, 'manifest ' || min(event_id) AS manifest FROM events WHERE event_id % 6 = 0 AND event_id % 4 <> 0 AND event_id % 40 < 30 GROUP BY event_id % 40",
    "fu_cell_streams": """WITH s AS (SELECT 'cell' || event_id % 50 AS cell_id, sha256(CAST(event_id AS VARCHAR)) AS p, event_id % 3 AS v, 'root/' || event_type || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '/leaf' END AS subject, event_id, event_type FROM events)
SELECT cell_id || '_' || substr(sha256(cell_id || '|' || p), 1, 12) AS stream_id, CASE v WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS claim, subject, CAST(1 + event_id % 5 AS INTEGER) AS source_tier, CASE WHEN v = 1 THEN 0.6e0 ELSE 0.5e0 END AS severity_impact,
  'root,' || event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',leaf' END AS tags FROM s""",
    "en_planes": """WITH k AS (SELECT c_custkey AS a FROM customer)
SELECT a AS artifact, 'email' AS kind, 'a' || a || '@example.com' AS form, 'container.from_addr' AS field FROM k WHERE a % 3 = 0
UNION ALL SELECT a, 'email', 'b' || a || '@d.org', 'container.from_addr' FROM k WHERE a % 4 = 0
UNION ALL SELECT a, 'person', a % 9 || ' person', 'app.author' FROM k WHERE a % 2 = 0
UNION ALL SELECT a, 'software', 'writer', 'app.producer' FROM k
UNION ALL SELECT a, 'organization', 'firm' || a % 7, 'app.company' FROM k WHERE a % 5 = 0
UNION ALL SELECT a, 'device', 'srv' || a % 5, 'app.template_server' FROM k WHERE a % 6 = 0
UNION ALL SELECT a, 'device', '10.0.0.' || a % 200, 'content.ip_addresses' FROM k
UNION ALL SELECT a, 'device', 'AA:BB:CC:00:11:22', 'content.mac_addresses' FROM k WHERE a % 8 = 0
UNION ALL SELECT a, 'device', '+49 30 1', 'content.phone_numbers' FROM k""",
    "tl_trend": """WITH e AS (SELECT o_custkey % 20 AS lane, o_orderkey, (o_orderkey % 110) / 100e0 AS u, (o_orderkey % 37) / 100e0 AS b FROM orders)
SELECT lane, count(*) AS epochs, round(avg(u), 6) AS avg_util, round(avg(b), 6) AS avg_backlog, CAST(arg_max(CASE WHEN u < 0.7 AND b > 0.05 THEN -1 WHEN u > 0.9 OR b > 0.2 THEN 1 ELSE 0 END, o_orderkey) AS INTEGER) AS recommendation FROM e GROUP BY lane""",
    "tl_registry": "WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 3 = 0) AS running, count(*) FILTER (WHERE p_partkey % 3 <> 0 AND p_partkey % 50 = 1) AS error FROM part) SELECT *, CASE WHEN error = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM c",
    "tl_bucket_stations": f"{telemetry_plans._RUNS} SELECT bucket, l_linenumber AS station, count(*) AS parts, count(DISTINCT run_id) AS runs FROM b JOIN lineitem ON l_orderkey = run_id GROUP BY bucket, l_linenumber",
    "tl_audit_counts": f"WITH {_OPS} SELECT count(*) AS operations, count(*) FILTER (WHERE blocked = 'M1') AS blocked_m1, count(*) FILTER (WHERE blocked = 'M2') AS blocked_m2, count(*) FILTER (WHERE blocked = 'M3') AS blocked_m3, count(*) FILTER (WHERE spec AND coalesce(blocked, 'M4') = 'M4') AS audited, count(*) FILTER (WHERE blocked = 'M4') AS diverged FROM c",
    "tm_pdf_anomalies": """SELECT event_id AS subject, 'future_dated' AS kind, 'critical' AS severity, 0.95e0 AS confidence FROM events WHERE ts > TIMESTAMP '2024-01-25'
UNION ALL SELECT event_id, 'weekend', 'medium', 0.7e0 FROM events WHERE isodow(ts) >= 6 UNION ALL SELECT event_id, 'after_hours', 'medium', 0.6e0 FROM events WHERE hour(ts) < 7 OR hour(ts) >= 18""",
    "ru_composed": """WITH p AS (SELECT user_id, unnest(['f' || event_id % 7, 'f' || event_id % 4]) AS v, event_id * 2 + unnest([0, 1]) AS pos FROM events),
g AS (SELECT user_id, 'low' AS v, event_id * 2 AS pos FROM events WHERE event_id % 3 = 1 UNION ALL SELECT user_id, 'r' || event_id % 5, event_id * 2 + 1 FROM events WHERE event_id % 3 = 1),
e AS (SELECT user_id, string_agg(v, ',' ORDER BY pos) AS evidence FROM (SELECT user_id, v, min(pos) AS pos FROM p GROUP BY ALL) GROUP BY user_id),
f AS (SELECT user_id, string_agg(v, ',' ORDER BY pos) AS flags FROM (SELECT user_id, v, min(pos) AS pos FROM g GROUP BY ALL) GROUP BY user_id)
SELECT user_id, evidence, coalesce(flags, '') AS flags FROM e LEFT JOIN f USING (user_id)""",
    "ru_policy_route": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'QUARANTINE' WHEN 2 THEN 'QUARANTINE' WHEN 3 THEN 'FAIL' ELSE 'ALLOW' END AS route FROM events",
    "ru_compliance": """WITH v AS (SELECT p_partkey AS part, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'no-unbound-projection' END, CASE WHEN p_partkey % 7 = 0 THEN 'no-empty-bindings' END, CASE WHEN p_partkey % 9 > CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 2 THEN 3 END THEN 'max-depth-exceeded' END,
  CASE WHEN p_partkey % 4 = 1 AND p_partkey % 2 = 1 THEN 'required-field-missing:b' WHEN p_partkey % 4 = 2 THEN 'required-field-missing:c' END) AS violations FROM part) SELECT part, CASE WHEN violations = '' THEN 'PASS' ELSE 'BLOCKED' END AS status, violations FROM v""",
    "ru_checkpoints": f"WITH {_OPS} SELECT i AS op, blocked FROM c",
    "ch_block_checks": f"""WITH RECURSIVE {chain_plans._BLOCKS}{chain_plans._MERKLE}, h AS (SELECT tenant, block, root, n_records, sha256(tenant || '|' || block || '|' || root || '|' || n_records) AS bh FROM roots),
l AS (SELECT *, coalesce(lag(bh) OVER (PARTITION BY tenant ORDER BY block), repeat('0', 64)) AS prev FROM h),
m AS (SELECT *, sha256(tenant || '|' || block || '|' || prev || '|' || root || '|' || n_records) AS made FROM l),
s AS (SELECT *, coalesce(lag(made) OVER (PARTITION BY tenant ORDER BY block), repeat('0', 64)) AS stated, CASE WHEN tenant % 7 = 0 AND block = 1 THEN sha256(made) ELSE made END AS integrity FROM m),
j AS (SELECT tenant, block, integrity, stated, root, n_records, coalesce(lag(integrity) OVER (PARTITION BY tenant ORDER BY block), repeat('0', 64)) AS before, tenant % 6 = 0 AND block = 1 AND n_records > 4 AS lost,
  CASE WHEN tenant % 5 = 0 AND block = 2 THEN 3 WHEN tenant % 9 = 0 THEN 0 ELSE n_records END AS said FROM s),
p AS (SELECT tenant, block, concat_ws(',', CASE WHEN stated <> before THEN 'CHAIN_BREAK' END, CASE WHEN said <> 0 AND said <> n_records - CASE WHEN lost THEN 1 ELSE 0 END THEN 'RECORD_COUNT_MISMATCH' END, CASE WHEN lost THEN 'MERKLE_MISMATCH' END,
  CASE WHEN lost OR integrity <> sha256(tenant || '|' || block || '|' || stated || '|' || root || '|' || n_records) THEN 'INTEGRITY_MISMATCH' END) AS problems FROM j)
SELECT tenant, min(block) AS first_block, arg_min(problems, block) AS problems FROM p WHERE problems <> '' GROUP BY tenant""",
    "ch_witness": f"""WITH RECURSIVE {chain_plans._BLOCKS}{_WHOLE_TREE} SELECT tenant, entries, head, tree.h AS root, substr(sha256(head || '|' || tree.h || '|1700000000'), 1, 32) AS checkpoint_id FROM tree JOIN n USING (tenant) WHERE size = 1""",
    "ch_ledger": """WITH RECURSIVE e AS (SELECT user_id AS ledger, event_id AS seq, event_type AS event, CASE WHEN event_id % 6 <> 0 THEN event_id % 50 END AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT ledger, seq, event, tokens, n, 'GENESIS' AS prev_hash, sha256('{"event":"' || event || '","prev_hash":"GENESIS","seq":' || seq || ',"tokens":' || coalesce(CAST(tokens AS VARCHAR), 'null') || '}') AS hash FROM e WHERE n = 1
UNION ALL SELECT e.ledger, e.seq, e.event, e.tokens, e.n, b.hash, sha256('{"event":"' || e.event || '","prev_hash":"' || b.hash || '","seq":' || e.seq || ',"tokens":' || coalesce(CAST(e.tokens AS VARCHAR), 'null') || '}') FROM b JOIN e ON e.ledger = b.ledger AND e.n = b.n + 1),
t AS (SELECT ledger, seq, event, CASE WHEN seq % 61 = 5 THEN 99 ELSE tokens END AS tokens, prev_hash, CASE WHEN seq % 131 <> 3 THEN hash END AS hash FROM b WHERE seq % 83 <> 7),
c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY ledger ORDER BY seq), 'GENESIS') AS before, sha256('{"event":"' || event || '","prev_hash":"' || prev_hash || '","seq":' || seq || ',"tokens":' || coalesce(CAST(tokens AS VARCHAR), 'null') || '}') AS own FROM t),
f AS (SELECT ledger, seq, CASE WHEN hash IS NULL THEN 'missing' WHEN prev_hash <> before THEN 'prev_hash mismatch' WHEN hash <> own THEN 'hash mismatch' END AS fault FROM c)
SELECT ledger, min(seq) AS first, arg_min(fault, seq) AS fault FROM f WHERE fault IS NOT NULL GROUP BY ledger""",
    "cl_findings": """WITH f AS (SELECT DISTINCT unnest([event_id % 150, event_id * 7 % 90]) AS a, event_id, event_type FROM events), g AS (SELECT a, count(*) AS n, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS findings FROM f GROUP BY a)
SELECT doc_id AS artifact, coalesce(n, 0) AS n, coalesce(findings, '') AS findings FROM documents LEFT JOIN g ON a = doc_id""",
    "tl_policies": """WITH r AS (SELECT event_id % 7 AS policy, user_id % 10 = 0 AS synthetic, event_type = 'error' AS blocked, CASE WHEN event_id % 3 <> 0 THEN [event_id % 4, event_id % 5] ELSE [] END AS v FROM events)
SELECT policy, synthetic, count(*) AS runs, count(*) FILTER (WHERE blocked) AS blocked, round(avg(CAST(blocked AS INTEGER)), 6) AS rate, CAST(sum(len(list_filter(v, lambda k: k = 1))) AS BIGINT) AS n_compression, CAST(sum(len(list_filter(v, lambda k: k > 2))) AS BIGINT) AS n_other, CAST(sum(len(list_filter(v, lambda k: k IN (0, 2)))) AS BIGINT) AS n_retrieval FROM r GROUP BY ALL""",
    "tl_critic_days": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value * 10) AS BIGINT) AS v FROM events WHERE event_type <> 'error')
SELECT day, count(*) AS n, median(v) AS p50, list_sort(list(v))[least(count(*), CAST(floor(count(*) * 0.95e0) AS BIGINT) + 1)] AS p95, max(v) AS max FROM e GROUP BY day""",
    "st_top_gear": f"SELECT event_id, gear, substr(sha256(event_id || '|' || gear), 1, 16) AS ts_hex FROM ({state_plans.ORACLES['st_gear']}) WHERE gear = 4",
}
