"""Queries on sealed blocks and proofs of chain entries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions.lineage import cut
from tallystone.operators import blocks as op
from tallystone.operators import chains
from tallystone.session import table

_MINUTES = 60_000_000


def _records(spark, sf_dir):
    """Turns of conversations of a few tenants, one of which has a third of them; their times follow from their numbers."""
    c, t = F.col("conv_id"), F.col("turn")
    tenant = F.when(c % 3 == 0, 0).otherwise(c % 12).cast("long")
    return table(spark, sf_dir, "conversations").select(tenant.alias("tenant"), (c * 4 * _MINUTES + t * t * 7_000_000).alias("ts_us"), (c * 1000 + t).alias("record"))


def ch_seal(spark, sf_dir):
    """Blocks of at most 20 records, or of those of 45 minutes."""
    return op.sealed_blocks(_records(spark, sf_dir), "tenant", "ts_us", "record", 20, 45 * _MINUTES)


def _leaves(spark, sf_dir):
    rows = op.numbered(_records(spark, sf_dir).select("tenant", "record"), "tenant", "record")
    return rows.select("tenant", "pos", F.sha2(F.concat_ws("|", "tenant", "record"), 256).alias("h"))


def ch_entry_proofs(spark, sf_dir):
    """Proofs of every seventh entry: how long, its digest, whether it leads to the root, and whether it does for another leaf."""
    nodes = cut(op.tree_nodes(_leaves(spark, sf_dir), "tenant"))
    asked = nodes.where("level = 0 AND pos % 7 = 3").select("tenant", "pos")
    proofs = op.entry_proofs(nodes, asked, "tenant")
    forged = F.aggregate("proof", F.sha2("leaf", 256), chains._parent) == F.col("root")
    return proofs.select("tenant", "pos", F.size("proof").alias("steps"), F.sha2(F.concat_ws(",", "leaf", "proof", "root"), 256).alias("digest"), chains.proof_holds().alias("holds"), forged.alias("forged"))


def _watchable(spark, sf_dir):
    """A block a conversation, chains of 40, of which some were exchanged, some lost, some linked to another block, some signed wrongly."""
    c = F.col("conv_id")
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.concat_ws(":", c, F.count(F.lit(1)), F.sum(F.length("text"))), 256).alias("hash"))
    made = chains.with_previous(made.select(F.floor(c / 40).alias("chain"), (c % 40).alias("height"), "hash"), "chain", "height", "hash")
    chain, h = F.col("chain"), F.col("height")
    previous = F.coalesce("previous.hash", F.lit(chains.GENESIS))
    spoiled = F.when((chain % 6 == 1) & (h == 1 + chain % 30), F.sha2(previous, 256)).otherwise(previous)
    fault = chains.own_fault((chain + 3 * h) % 97 != 5, F.when(chain % 3 == 0, (chain + h) % 89 != 7))
    return made.where("NOT (chain % 4 = 2 AND height = 3 + chain % 25)").select("chain", "height", "hash", spoiled.alias("previous"), fault.alias("own_fault"))


def ch_watch(spark, sf_dir):
    return chains.watched_blocks(_watchable(spark, sf_dir))


def ch_watch_report(spark, sf_dir):
    return chains.integrity_report(chains.watched_blocks(_watchable(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (ch_seal, ch_entry_proofs, ch_watch, ch_watch_report)}

_RECORDS = "r AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 12 END AS tenant, conv_id * 240000000 + turn * turn * 7000000 AS ts, conv_id * 1000 + turn AS record FROM conversations)"
_WATCH = """b AS (SELECT conv_id, sha256(conv_id || ':' || count(*) || ':' || CAST(sum(length(text)) AS BIGINT)) AS hash FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id // 40 AS chain, conv_id % 40 AS height, hash, coalesce(lag(hash) OVER (PARTITION BY conv_id // 40 ORDER BY conv_id), repeat('0', 64)) AS previous FROM b),
w AS (
  SELECT chain, height, hash, CASE WHEN chain % 6 = 1 AND height = 1 + chain % 30 THEN sha256(previous) ELSE previous END AS stated,
    CASE WHEN chain % 3 = 0 AND (chain + height) % 89 = 7 THEN 'SIGNATURE_INVALID' WHEN (chain + 3 * height) % 97 = 5 THEN 'HASH_MISMATCH' END AS own
  FROM l WHERE NOT (chain % 4 = 2 AND height = 3 + chain % 25)
), before AS (
  SELECT *, coalesce(lag(height) OVER v, -1) + 1 AS due, coalesce(lag(hash) OVER v, repeat('0', 64)) AS link FROM w WINDOW v AS (PARTITION BY chain ORDER BY height)
), faults AS (
  SELECT chain, height, CASE WHEN own IS NOT NULL THEN own WHEN height <> due THEN 'HEIGHT_GAP' WHEN stated <> link THEN 'CHAIN_BREAK' END AS fault,
    CASE WHEN own IS NOT NULL THEN NULL WHEN height <> due THEN due::VARCHAR WHEN stated <> link THEN link END AS expected,
    CASE WHEN own IS NOT NULL THEN NULL WHEN height <> due THEN height::VARCHAR WHEN stated <> link THEN stated END AS actual
  FROM before
), watched AS (SELECT * FROM faults f WHERE NOT EXISTS (FROM faults e WHERE e.chain = f.chain AND e.height < f.height AND e.fault IS NOT NULL))"""

ORACLES = {
    "ch_seal": f"""WITH RECURSIVE {_RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts, record) AS i FROM r),
f AS (SELECT tenant, i, record, ts, 0 AS block, ts AS began, 1 AS held FROM n WHERE i = 1
  UNION ALL SELECT n.tenant, n.i, n.record, n.ts, f.block + CAST(f.held = 20 OR f.ts - f.began >= {45 * _MINUTES} AS INTEGER), CASE WHEN f.held = 20 OR f.ts - f.began >= {45 * _MINUTES} THEN n.ts ELSE f.began END,
    CASE WHEN f.held = 20 OR f.ts - f.began >= {45 * _MINUTES} THEN 1 ELSE f.held + 1 END FROM f JOIN n ON n.tenant = f.tenant AND n.i = f.i + 1)
SELECT tenant, CAST(block AS BIGINT) AS block, arg_min(record, i) AS first, arg_max(record, i) AS last, count(*) AS n_records, max(ts) - min(ts) AS age,
  CASE WHEN count(*) = 20 THEN 'records' WHEN max(ts) - min(ts) >= {45 * _MINUTES} THEN 'age' ELSE 'open' END AS reason FROM f GROUP BY tenant, block""",
    "ch_entry_proofs": f"""WITH RECURSIVE {_RECORDS}, l AS (SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY record) - 1 AS pos, sha256(tenant || '|' || record) AS h, count(*) OVER (PARTITION BY tenant) AS n FROM r),
tree AS (SELECT tenant, 0 AS level, pos, sha256('\\x00'::BLOB || h::BLOB) AS h, n AS size FROM l
  UNION ALL SELECT tenant, level + 1, pos // 2, sha256(min(h) || max(h)), any_value((size + 1) // 2) FROM tree WHERE size > 1 GROUP BY ALL),
asked AS (SELECT tenant, pos, h AS leaf FROM tree WHERE level = 0 AND pos % 7 = 3), root AS (SELECT tenant, level AS height, h AS root FROM tree WHERE size = 1),
step AS (SELECT a.tenant, a.pos, t.level, t.h FROM asked a JOIN root USING (tenant) JOIN tree t ON t.tenant = a.tenant AND t.level < height AND t.pos = CASE WHEN xor(a.pos >> t.level, 1) < t.size THEN xor(a.pos >> t.level, 1) ELSE a.pos >> t.level END)
SELECT tenant, pos, CAST(count(level) AS INTEGER) AS steps, sha256(any_value(leaf) || ',' || coalesce(string_agg(h, ',' ORDER BY level) || ',', '') || any_value(root)) AS digest, true AS holds, false AS forged
FROM asked JOIN root USING (tenant) LEFT JOIN step USING (tenant, pos) GROUP BY tenant, pos""",
    "ch_watch": f"WITH {_WATCH} FROM watched",
    "ch_watch_report": f"""WITH {_WATCH} SELECT chain, count(*) AS checked, count(*) FILTER (WHERE fault IS NULL) AS passed, count(fault) = 0 AS chain_valid,
  max(fault) AS reason, max(height) FILTER (WHERE fault IS NOT NULL) AS height, max(expected) AS expected, max(actual) AS actual FROM watched GROUP BY chain""",
}
