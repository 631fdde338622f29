"""Chain, block and custody queries; chains are built from ``events``, one for each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import chains as op
from tallystone.session import table


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.concat_ws(":", "event_id", "event_type").alias("payload"))


def ch_build(spark, sf_dir):
    return op.build_chain(_entries(spark, sf_dir)).select("chain", "seq", "hash")


def _tampered(spark, sf_dir):
    """Every 97th line's text is edited and every 89th is removed after the chain was built."""
    edited = F.when(F.col("seq") % 97 == 5, F.concat(F.col("line"), F.lit("!"))).otherwise(F.col("line"))
    return op.build_chain(_entries(spark, sf_dir)).where("seq % 89 <> 7").withColumn("line", edited)


def ch_verify(spark, sf_dir):
    return op.verify_chain(_tampered(spark, sf_dir))


def ch_first_break(spark, sf_dir):
    return op.first_break(op.verify_chain(_tampered(spark, sf_dir)))


def _records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), "event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"))
    return op.with_block(e, "tenant", "event_id", 20).withColumn("h", op.record_hash("tenant", "event_id", "event_type", "props"))


def ch_record_hash(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", "h")


def ch_blocks(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("tenant", "block").agg(F.count(F.lit(1)).alias("n_records"), F.min("event_id").alias("first"), F.max("slot").alias("last_slot"))


def ch_merkle(spark, sf_dir):
    return op.merkle_roots(_records(spark, sf_dir), "tenant", "block")


def ch_inclusion(spark, sf_dir):
    """Leaves whose inclusion proof leads to their block's root, also after the leaf was exchanged for another."""
    proofs = op.inclusion_proofs(op.merkle_levels(_records(spark, sf_dir), "tenant", "block"), "tenant", "block")
    forged = proofs.withColumn("leaf", F.sha2("leaf", 256))
    return proofs.where(op.proof_holds()).groupBy("tenant").agg(F.count(F.lit(1)).alias("holds")).join(forged.where(op.proof_holds()).groupBy("tenant").agg(F.count(F.lit(1)).alias("forged")), "tenant", "left").na.fill(0)


def ch_block_chain(spark, sf_dir):
    return op.block_chain(op.merkle_roots(_records(spark, sf_dir), "tenant", "block"), "tenant").select("tenant", "block", "previous", "block_hash")


def _plain_blocks(spark, sf_dir):
    b = ch_blocks(spark, sf_dir).withColumn("root", F.sha2(F.col("first").cast("string"), 256))
    return op.block_chain(b, "tenant")


def ch_block_faults(spark, sf_dir):
    """Blocks after every block 1 of tenants that divide by 4 is removed, and block 0 of those that divide by 6 is rehashed."""
    b = _plain_blocks(spark, sf_dir).where("NOT (tenant % 4 = 0 AND block = 1)")
    b = b.withColumn("block_hash", F.when((F.col("tenant") % 6 == 0) & (F.col("block") == 0), F.sha2("block_hash", 256)).otherwise(F.col("block_hash")))
    return op.block_faults(b, "tenant")


def ch_unanchored(spark, sf_dir):
    b = _plain_blocks(spark, sf_dir)
    return op.unanchored(b, b.where("tenant % 3 <> 0")).select("tenant", "block")


def ch_quorum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.floor(F.col("event_id") / 10).alias("checkpoint"), (F.col("user_id") % 40).alias("signer"), (F.col("event_id") % 23 != 0).alias("valid"))
    return op.quorum(s, spark.range(36).select(F.col("id").alias("signer")), 5)


def ch_compare(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("payload"))
    b = a.where("pos % 1000 <> 1").withColumn("payload", F.when(F.col("pos") % 500 == 2, F.lit("changed")).otherwise(F.col("payload")))
    return op.compare_ingests(a, b)


def ch_replay_state(spark, sf_dir):
    return op.replay_state(table(spark, sf_dir, "events").withColumnRenamed("event_type", "state"), "user_id", "event_id")


def ch_custody(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    acts = e.select(
        (F.col("user_id") % 50).alias("evidence"), i.alias("seq"), F.when(i % 9 == 0, "acquire").when(i % 9 < 7, "transfer").otherwise("note").alias("act"), (i % 3).alias("actor"), ((i * 7 + 1) % 3).alias("to")
    )
    return op.custody_faults(acts)


def ch_tail(spark, sf_dir):
    """The newest 3 entries of each chain, without ranking the rest of a long chain in one task first."""
    return spark.sql("SELECT chain, seq FROM (SELECT chain, seq, row_number() OVER (PARTITION BY chain ORDER BY seq DESC) AS n FROM {e}) WHERE n <= 3", e=_entries(spark, sf_dir))


def ch_iso_nanos(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") * 7919 % 1000000000).cast("string"), 9, "0"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", op.iso_to_nanos(text).alias("ts_ns"))


_BUILD = """WITH RECURSIVE e AS (
  SELECT user_id AS chain, event_id AS seq, event_id || ':' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), built AS (
  SELECT chain, seq, n, payload || '|' || repeat('0', 64) AS line, repeat('0', 64) AS prev_hash FROM e WHERE n = 1
  UNION ALL
  SELECT e.chain, e.seq, e.n, e.payload || '|' || sha256(b.line || chr(10)), sha256(b.line || chr(10)) FROM built b JOIN e ON e.chain = b.chain AND e.n = b.n + 1
)"""
_TAMPER = """, t AS (SELECT chain, seq, prev_hash, CASE WHEN seq % 97 = 5 THEN line || '!' ELSE line END AS line FROM built WHERE seq % 89 <> 7),
checked AS (SELECT chain, seq, prev_hash = coalesce(lag(sha256(line || chr(10))) OVER (PARTITION BY chain ORDER BY seq), repeat('0', 64)) AS ok FROM t)"""
_BLOCKS = """r AS (
  SELECT user_id AS tenant, event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN props END AS props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events
), rec AS (
  SELECT tenant, event_id, n // 20 AS block, CAST(n % 20 AS INTEGER) AS slot, sha256(tenant || '|' || event_id || '|' || event_type || '|' || coalesce(props, '')) AS h FROM r
)"""
_MERKLE = """, tree AS (
  SELECT tenant, block, 0 AS depth, slot AS pos, sha256('\\x00'::BLOB || h::BLOB) AS h, count(*) OVER (PARTITION BY tenant, block) AS size FROM rec
  UNION ALL
  SELECT tenant, block, depth + 1, pos // 2, sha256(min(h) || max(h)), any_value((size + 1) // 2) FROM tree WHERE size > 1 GROUP BY ALL
), roots AS (SELECT tenant, block, h AS root, (SELECT count(*) FROM rec WHERE rec.tenant = tree.tenant AND rec.block = tree.block) AS n_records FROM tree WHERE size = 1)"""
_PLAIN = """, b AS (SELECT tenant, block, count(*) AS n_records, min(event_id) AS first, sha256(CAST(min(event_id) AS VARCHAR)) AS root FROM rec GROUP BY tenant, block),
hashed AS (SELECT *, sha256(tenant || '|' || block || '|' || root || '|' || n_records) AS block_hash FROM b),
linked AS (SELECT *, coalesce(lag(block_hash) OVER (PARTITION BY tenant ORDER BY block), repeat('0', 64)) AS previous FROM hashed)"""

QUERIES = {f.__name__: f for f in (
    ch_build, ch_verify, ch_first_break, ch_record_hash, ch_blocks, ch_merkle, ch_inclusion, ch_block_chain, ch_block_faults, ch_unanchored, ch_quorum, ch_compare, ch_replay_state, ch_custody, ch_tail, ch_iso_nanos,
)}

ORACLES = {
    "ch_build": f"{_BUILD} SELECT chain, seq, sha256(line || chr(10)) AS hash FROM built",
    "ch_verify": f"{_BUILD}{_TAMPER} FROM checked",
    "ch_first_break": f"{_BUILD}{_TAMPER} SELECT chain, count(*) AS n_lines, min(seq) FILTER (WHERE NOT ok) AS first_break FROM checked GROUP BY chain",
    "ch_record_hash": f"WITH {_BLOCKS} SELECT event_id, h FROM rec",
    "ch_blocks": f"WITH {_BLOCKS} SELECT tenant, block, count(*) AS n_records, min(event_id) AS first, max(slot) AS last_slot FROM rec GROUP BY tenant, block",
    "ch_merkle": f"WITH RECURSIVE {_BLOCKS}{_MERKLE} SELECT tenant, block, n_records, root FROM roots",
    "ch_inclusion": "SELECT user_id AS tenant, count(*) AS holds, CAST(0 AS BIGINT) AS forged FROM events GROUP BY user_id",
    "ch_block_chain": f"""WITH RECURSIVE {_BLOCKS}{_MERKLE}, hashed AS (SELECT *, sha256(tenant || '|' || block || '|' || root || '|' || n_records) AS block_hash FROM roots)
SELECT tenant, block, coalesce(lag(block_hash) OVER (PARTITION BY tenant ORDER BY block), repeat('0', 64)) AS previous, block_hash FROM hashed""",
    "ch_block_faults": f"""WITH {_BLOCKS}{_PLAIN}, changed AS (SELECT tenant, block, previous, CASE WHEN tenant % 6 = 0 AND block = 0 THEN sha256(block_hash) ELSE block_hash END AS block_hash FROM linked WHERE NOT (tenant % 4 = 0 AND block = 1)),
judged AS (SELECT tenant, block, CASE WHEN block <> coalesce(lag(block) OVER w, -1) + 1 THEN 'height_gap' WHEN previous <> coalesce(lag(block_hash) OVER w, repeat('0', 64)) THEN 'link_break' END AS fault FROM changed WINDOW w AS (PARTITION BY tenant ORDER BY block))
FROM judged WHERE fault IS NOT NULL""",
    "ch_unanchored": f"WITH {_BLOCKS}{_PLAIN} SELECT tenant, block FROM linked WHERE tenant % 3 = 0",
    "ch_quorum": """WITH s AS (SELECT event_id // 10 AS checkpoint, user_id % 40 AS signer, event_id % 23 <> 0 AND user_id % 40 < 36 AS good FROM events),
g AS (SELECT checkpoint, signer, count(*) AS n, bool_and(good) AS good FROM s GROUP BY ALL), c AS (SELECT checkpoint, count(*) FILTER (WHERE good) AS signers, count(*) FILTER (WHERE NOT good OR n > 1) AS rejected FROM g GROUP BY checkpoint)
SELECT *, signers >= 5 AND rejected = 0 AS reached FROM c""",
    "ch_compare": """WITH b AS (SELECT event_id, CASE WHEN event_id % 500 = 2 THEN 'changed' ELSE event_type END AS p FROM events WHERE event_id % 1000 <> 1),
c AS (SELECT count(*) FILTER (WHERE p IS NULL) AS missing, count(*) FILTER (WHERE p <> event_type) AS different FROM events LEFT JOIN b USING (event_id))
SELECT *, CASE WHEN missing > 0 THEN 'INCOMPLETE' WHEN different > 0 THEN 'DIFF' ELSE 'MATCH' END AS verdict FROM c""",
    "ch_replay_state": "SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n_entries FROM events GROUP BY user_id",
    "ch_custody": """WITH a AS (SELECT user_id % 50 AS evidence, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'acquire' WHEN event_id % 9 < 7 THEN 'transfer' ELSE 'note' END AS act, event_id % 3 AS actor, (event_id * 7 + 1) % 3 AS dest FROM events),
h AS (SELECT *, (SELECT CASE p.act WHEN 'acquire' THEN p.actor ELSE p.dest END FROM a p WHERE p.evidence = a.evidence AND p.seq < a.seq AND p.act <> 'note' ORDER BY p.seq DESC LIMIT 1) AS holder,
  (SELECT count(*) FROM a p WHERE p.evidence = a.evidence AND p.seq < a.seq AND p.act = 'acquire') AS acquired FROM a),
f AS (SELECT evidence, seq, CASE WHEN act = 'acquire' AND acquired > 0 THEN 'second_acquire' WHEN act = 'transfer' AND acquired = 0 THEN 'transfer_before_acquire' WHEN act = 'transfer' AND actor <> holder THEN 'not_holder' END AS fault, holder FROM h)
FROM f WHERE fault IS NOT NULL""",
    "ch_tail": "SELECT user_id AS chain, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3",
    "ch_iso_nanos": "SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) * 1000 + event_id * 7919 % 1000000000 - CASE WHEN event_id % 2 = 1 THEN 7200000000000 ELSE 0 END AS ts_ns FROM events",
}
