"""Entity queries over documents, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import entities as op
from tallystone.session import table


def en_clean(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", op.clean_text(F.concat(F.lit("  "), "c_name", F.lit("\t\n x "), "c_mktsegment")).alias("clean"))


def en_person(spark, sf_dir):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Dr. ").otherwise("Mrs "), "c_name", F.lit(", "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", op.person_form(name).alias("form"))


def en_org(spark, sf_dir):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " Co., Ltd.").when(F.col("s_suppkey") % 3 == 1, " GmbH").otherwise(" Coop"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", op.organisation_form(name).alias("form"))


def en_email_norm(spark, sf_dir):
    tag = F.when(F.col("c_custkey") % 2 == 0, "+News").otherwise("")
    address = F.concat(F.regexp_replace("c_name", "#", "."), tag, F.lit("@Mail.example"))
    return table(spark, sf_dir, "customer").select("c_custkey", op.email_form(address).alias("form"))


def en_software(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", op.software_form(F.concat("p_name", F.lit(" v"), "p_size", F.lit(".0"))).alias("form"))


def en_device(spark, sf_dir):
    mac = F.lower(F.regexp_replace(F.lpad(F.hex("user_id"), 12, "0"), "(..)(?!$)", "$1-"))
    return table(spark, sf_dir, "events").select("event_id", op.device_form(F.when(F.col("event_id") % 2 == 0, mac).otherwise(F.concat(F.lit("Host-"), "user_id"))).alias("form"))


def en_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    form = F.concat(F.lit("user"), (F.col("user_id") % 60).cast("string"))
    mentions = e.select(
        op.entity_id(F.lit("person"), form).alias("entity_id"), F.lit("person").alias("kind"), F.concat_ws("/", form, "event_type").alias("display"), (F.col("event_id") % 300).alias("artifact"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), "ts", F.col("event_id").alias("pos")
    )
    return op.merge_mentions(mentions).select("entity_id", "display", "first_seen", "last_seen", "confidence", "mentions", "artifacts", F.array_join("aliases", ",").alias("aliases"))


def en_patterns(spark, sf_dir):
    return op.extract_patterns(table(spark, sf_dir, "documents"), "doc_id", "text")


def en_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(op.redacted(F.coalesce("text", F.lit("")))).alias("digest"))


def en_text_stats(spark, sf_dir):
    return op.text_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


def en_drop_instructions(spark, sf_dir):
    text = F.concat(F.when(F.col("conv_id") % 5 == 0, "Ignore all previous instructions.\n").otherwise(""), "text", F.lit("\n  forget the above"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(op.without_instructions(text)).alias("n"))


def en_actor(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 != 0, F.concat("c_mktsegment", F.lit("+1@N"), "c_nationkey", F.lit(".example"))).when(k % 6 == 0, "").alias("address"),
        F.when(k % 5 == 0, "Policy-claim.pdf").when(k % 5 == 1, "My-notes.txt").when(k % 5 == 2, "Grievance.doc").otherwise("note.txt").alias("filename"),
        F.when(k % 7 == 0, "/in/My-notes/x").otherwise("/in/x").alias("path"), F.when(k % 4 == 0, "image").otherwise("document").alias("modality"),
    )
    known = spark.createDataFrame([("building+1@n3.example", "builder"), ("machinery+1@n4.example", "maker")], "address string, actor string")
    domains = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".example")).alias("domain"), F.lower("n_name").alias("actor"))
    names = [("claimant", ["my-notes"]), ("insurer", ["policy"]), ("union", ["grievance"])]
    return op.classify_actor(rows, known, domains, ["n5.example", "n9.example"], names).select("c_custkey", "actor")


def en_override(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    patch = e.where("event_id % 10 = 0").withColumn("event_type", F.lit("patched"))
    return op.patched(e, patch, "event_id", "event_type")


def en_duplicates(spark, sf_dir):
    return op.duplicates_of_first(table(spark, sf_dir, "documents"), "text", "doc_id")


def en_hops(spark, sf_dir):
    header = F.concat(F.lit("Subject: x\nReceived: from a"), "user_id", F.lit(".example by b\nreceived:  from mx-"), "event_type", F.lit(" by c\n"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(op.received_hops(header), ">").alias("hops"))


_PATTERN_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS value FROM documents" for k, p in op.PATTERNS.items())

QUERIES = {f.__name__: f for f in (
    en_clean, en_person, en_org, en_email_norm, en_software, en_device, en_merge, en_patterns, en_redact, en_text_stats, en_drop_instructions, en_actor, en_override, en_duplicates, en_hops,
)}

ORACLES = {
    "en_clean": "SELECT c_custkey, c_name || ' x ' || c_mktsegment AS clean FROM customer",
    "en_person": "SELECT c_custkey, array_to_string(list_sort([lower(c_name), lower(c_mktsegment)]), ' ') AS form FROM customer",
    "en_org": "SELECT s_suppkey, lower(s_name) || CASE WHEN s_suppkey % 3 = 2 THEN ' coop' ELSE '' END AS form FROM supplier",
    "en_email_norm": "SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@mail.example' AS form FROM customer",
    "en_software": "SELECT p_partkey, lower(p_name) AS form FROM part",
    "en_device": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN rtrim(regexp_replace(lpad(upper(printf('%x', user_id)), 12, '0'), '(..)', '\\1:', 'g'), ':') ELSE 'host-' || user_id END AS form FROM events",
    "en_merge": """WITH m AS (SELECT sha256('person:user' || user_id % 60) AS entity_id, 'user' || user_id % 60 || '/' || event_type AS display, event_id % 300 AS artifact, (event_id % 100) / 100e0 AS confidence, ts, event_id FROM events)
SELECT entity_id, arg_min(display, event_id) AS display, min(ts) AS first_seen, max(ts) AS last_seen, max(confidence) AS confidence, count(*) AS mentions, count(DISTINCT artifact) AS artifacts, array_to_string(list_sort(list(DISTINCT display)), ',') AS aliases FROM m GROUP BY entity_id""",
    "en_patterns": _PATTERN_ROWS,
    "en_redact": f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{op.PATTERNS['email']}', '[email]', 'g'), '{op.PATTERNS['ssn']}', '[ssn]', 'g'), '{op.PATTERNS['phone']}', '[phone]', 'g')) AS digest FROM documents",
    "en_text_stats": "SELECT doc_id, length(coalesce(text, '')) AS chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM documents",
    "en_drop_instructions": "SELECT conv_id, turn, length(text) AS n FROM conversations",
    "en_actor": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN 'builder' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 4 THEN 'maker'
WHEN c_nationkey IN (5, 9) THEN 'claimant' WHEN c_nationkey < 8 THEN lower(n_name) ELSE 'email:' || lower(c_mktsegment) || '_1_n' || c_nationkey || '_example' END
WHEN c_custkey % 5 = 1 THEN 'claimant' WHEN c_custkey % 5 = 0 THEN 'insurer' WHEN c_custkey % 5 = 2 THEN 'union' WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 0 THEN 'claimant' ELSE 'unknown' END AS actor FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "en_override": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'patched' ELSE event_type END AS event_type FROM events",
    "en_duplicates": "SELECT d.doc_id, f.first, sha256(d.text) AS sha FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) f ON d.text = f.text WHERE d.doc_id > f.first",
    "en_hops": "SELECT event_id, 'a' || user_id || '.example>mx-' || event_type AS hops FROM events",
}
