"""Fusion queries over the stream view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import fusion as op
from tallystone.session import table
from tallystone.plans.views import NOW, STREAMS, streams


def _scored(spark, sf_dir):
    return op.scored(streams(spark, sf_dir), NOW)


def fu_topn(spark, sf_dir):
    rows = op.ranked(_scored(spark, sf_dir))
    return rows.select("stream_id", "type", F.round("composite", 9).alias("composite"), "band")


def fu_score(spark, sf_dir):
    rows = op.flagged(streams(spark, sf_dir), NOW)
    return rows.select("stream_id", "type", "authority", F.round("freshness", 9).alias("freshness"), "corroboration", F.round("composite", 9).alias("composite"), "flags")


def fu_accept_reject(spark, sf_dir):
    return op.acceptance(_scored(spark, sf_dir))


def fu_conclusions(spark, sf_dir):
    return op.conclusions(_scored(spark, sf_dir))


def fu_conflicts(spark, sf_dir):
    pairs = op.conflicts(_scored(spark, sf_dir))
    return pairs.select("type", F.col("p.stream_id").alias("positive"), F.col("n.stream_id").alias("negative"))


def fu_arbitrate(spark, sf_dir):
    return op.arbitrated(op.conflicts(_scored(spark, sf_dir))).withColumn("gap", F.round("gap", 9))


def fu_overruled(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    lost = op.arbitrated(op.conflicts(rows)).where("loser IS NOT NULL").select(F.col("loser").alias("stream_id"))
    return rows.join(lost, "stream_id", "left_semi").select("stream_id", "type", "claim")


def fu_anomaly_dup(spark, sf_dir):
    return op.repeated_hashes(streams(spark, sf_dir))


def fu_anomaly_flood(spark, sf_dir):
    return op.flooded_types(streams(spark, sf_dir))


def fu_future(spark, sf_dir):
    return op.split_future(streams(spark, sf_dir), "2024-01-29 12:00:00")[1].select("stream_id")


def fu_sensitivity(spark, sf_dir):
    return op.sensitivity(streams(spark, sf_dir), NOW)


def fu_sensitivity_single(spark, sf_dir):
    return op.sensitivity_single(streams(spark, sf_dir), NOW)


def _versions(spark, sf_dir):
    s = streams(spark, sf_dir)
    new = s.where("stream_id % 5 <> 1").withColumn("confidence", F.when(F.col("stream_id") % 6 == 0, F.col("confidence") + 0.125).otherwise(F.col("confidence")))
    return s.where("stream_id % 5 <> 0"), new


def fu_version_diff(spark, sf_dir):
    return op.version_diff(*_versions(spark, sf_dir))


def fu_synthesis(spark, sf_dir):
    return op.synthesis(*(op.scored(v, NOW) for v in _versions(spark, sf_dir)))


def fu_synthesis_tiers(spark, sf_dir):
    return op.synthesis_summary(op.scored(_versions(spark, sf_dir)[1], NOW))


def fu_feedback(spark, sf_dir):
    i = F.col("event_id")
    feedback = table(spark, sf_dir, "events").select(
        (i % 30).alias("case_id"), F.concat(F.lit("u"), F.col("user_id")).alias("author"), F.when(i % 3 == 0, "accept").when(i % 3 == 1, "reject").otherwise("comment").alias("verdict"), F.when(i % 4 != 0, F.col("props")).alias("comment"), "ts"
    )
    return op.feedback_streams(feedback).select("stream_id", "subject", "claim", "provenance_hash", "ts")


def fu_timeline(spark, sf_dir):
    """Streams in time order with their score, 0 for those that were not scored (here: neutral claims)."""
    score = _scored(spark, sf_dir).where("claim <> 'neutral'").select("stream_id", F.round("composite", 9).alias("score"))
    return streams(spark, sf_dir).join(score, "stream_id", "left").select("stream_id", "ts", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("ts", "stream_id")


def _sql(source: str, tag: str = "", factor: str = "1e0") -> str:
    """CTEs that score ``source``; corroboration is counted pair by pair of (subject, claim), independent of the operator."""
    return f"""
aged{tag} AS (
  SELECT s.*, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 AS age, {factor} AS factor FROM {source} s
), backed{tag} AS (
  SELECT a.*, CASE WHEN claim = 'neutral' THEN 0 ELSE (SELECT count(*) FROM {source} o WHERE o.subject = a.subject AND o.claim = a.claim AND o.stream_id <> a.stream_id) END AS corroboration
  FROM aged{tag} a WHERE age >= -60
), scored{tag} AS (
  SELECT b.*, CASE source_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0.8e0 WHEN 4 THEN 0.6e0 ELSE 0.3e0 END * CASE WHEN signature_valid THEN 1e0 ELSE 0.5e0 END AS authority,
    CASE WHEN half_life IS NULL OR half_life <= 0 THEN 1e0 ELSE pow(0.5e0, greatest(age, 0) / 3600 / (half_life * factor)) END AS freshness FROM backed{tag} b
), composed{tag} AS (
  SELECT *, authority * (0.35e0 * severity_impact + 0.25e0 * freshness + 0.25e0 * confidence + 0.15e0 * (least(corroboration, 10) / 10e0)) AS composite FROM scored{tag}
)"""


_BASE = f"WITH {STREAMS}, {_sql('streams')}"
_CONCLUDE = "SELECT subject, CASE claim WHEN 'positive' THEN 'supported' ELSE 'opposed' END AS polarity, min(stream_id) AS first_stream FROM {0} WHERE composite >= 0.5 AND claim <> 'neutral' GROUP BY ALL"
_SIDES = """, ranks AS (
  SELECT *, row_number() OVER (PARTITION BY type, claim ORDER BY composite DESC, stream_id) AS r FROM composed WHERE claim <> 'neutral'
), pairs AS (
  SELECT p.type, p.stream_id AS pid, n.stream_id AS nid, p.source_tier AS pt, n.source_tier AS nt, p.composite - n.composite AS gap, p.ts AS pts, n.ts AS nts, p.corroboration AS pc, n.corroboration AS nc
  FROM ranks p JOIN ranks n ON p.type = n.type AND p.r = 1 AND n.r = 1 AND p.claim = 'positive' AND n.claim = 'negative'
), ruled AS (
  SELECT *, CASE WHEN abs(pt - nt) >= 2 THEN 'authority' WHEN abs(gap) >= 0.15 THEN 'score' WHEN abs(gap) < 0.05 THEN 'dispute' WHEN pts <> nts THEN 'freshness' WHEN pc <> nc THEN 'corroboration' ELSE 'dispute' END AS rule FROM pairs
), judged AS (
  SELECT *, CASE rule WHEN 'authority' THEN pt < nt WHEN 'score' THEN gap > 0 WHEN 'freshness' THEN pts > nts WHEN 'corroboration' THEN pc > nc END AS first FROM ruled
)"""
_BANDS = "CASE WHEN composite < 0.5 THEN 'unreliable' WHEN composite >= 0.85 THEN 'high' WHEN composite >= 0.65 THEN 'moderate' ELSE 'low' END"
_DUPLICATES = "SELECT DISTINCT provenance_hash FROM (SELECT provenance_hash, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY provenance_hash ORDER BY ts) AS gap FROM streams) WHERE gap <= 3600000000"
_VERSIONS = """, old AS (SELECT * FROM streams WHERE stream_id % 5 <> 0), new AS (
  SELECT * REPLACE (CASE WHEN stream_id % 6 = 0 THEN confidence + 0.125e0 ELSE confidence END AS confidence) FROM streams WHERE stream_id % 5 <> 1
)"""

QUERIES = {f.__name__: f for f in (
    fu_topn, fu_score, fu_accept_reject, fu_conclusions, fu_conflicts, fu_arbitrate, fu_overruled, fu_anomaly_dup, fu_anomaly_flood, fu_future, fu_sensitivity, fu_sensitivity_single, fu_version_diff, fu_synthesis, fu_synthesis_tiers, fu_feedback, fu_timeline,
)}

ORACLES = {
    "fu_topn": f"{_BASE} SELECT stream_id, type, round(composite, 9) AS composite, {_BANDS} AS band FROM composed ORDER BY composed.composite DESC, stream_id LIMIT 5",
    "fu_score": f"""{_BASE}, dup AS ({_DUPLICATES}), flood AS (SELECT type FROM streams GROUP BY type HAVING count(*) > 10)
SELECT stream_id, type, authority, round(freshness, 9) AS freshness, CAST(corroboration AS BIGINT) AS corroboration, round(composite, 9) AS composite,
  array_to_string(list_sort(list_filter([CASE WHEN half_life IS NULL THEN 'decay_missing' END, 'claim_' || claim,
    CASE WHEN signature_valid IS NULL THEN 'unsigned' WHEN signature_valid THEN 'signature_valid' ELSE 'signature_invalid' END,
    CASE WHEN age > 365 * 86400 THEN 'stale' END, CASE WHEN provenance_hash IN (FROM dup) THEN 'duplicate_provenance' END,
    CASE WHEN type IN (FROM flood) THEN 'type_flooding' END], lambda x: x IS NOT NULL)), ',') AS flags FROM composed""",
    "fu_accept_reject": f"{_BASE} SELECT type, count(*) FILTER (WHERE composite >= 0.5) AS accepted, count(*) FILTER (WHERE composite < 0.5) AS rejected FROM composed GROUP BY type",
    "fu_conclusions": f"{_BASE} {_CONCLUDE.format('composed')}",
    "fu_conflicts": f"{_BASE}{_SIDES} SELECT type, pid AS positive, nid AS negative FROM pairs",
    "fu_arbitrate": f"""{_BASE}{_SIDES} SELECT type, substr(sha256(pid || '|' || nid), 1, 16) AS conflict_id, rule,
  CASE WHEN first THEN pid WHEN NOT first THEN nid END AS winner, CASE WHEN first THEN nid WHEN NOT first THEN pid END AS loser, round(abs(gap), 9) AS gap FROM judged""",
    "fu_overruled": f"{_BASE}{_SIDES} SELECT stream_id, type, claim FROM streams WHERE stream_id IN (SELECT CASE WHEN first THEN nid ELSE pid END FROM judged WHERE first IS NOT NULL)",
    "fu_anomaly_dup": f"WITH {STREAMS} {_DUPLICATES}",
    "fu_anomaly_flood": f"WITH {STREAMS} SELECT type, count(*) AS n_streams FROM streams GROUP BY type HAVING count(*) > 10",
    "fu_future": f"WITH {STREAMS} SELECT stream_id FROM streams WHERE ts > TIMESTAMP '2024-01-29 12:00:00' + INTERVAL 60 SECOND",
    "fu_sensitivity": f"""{_BASE}, {_sql('streams', '_lo', '0.5e0')}, {_sql('streams', '_hi', '1.5e0')},
base AS ({_CONCLUDE.format('composed')}), lo AS ({_CONCLUDE.format('composed_lo')}), hi AS ({_CONCLUDE.format('composed_hi')}),
after AS (SELECT 0.5e0 AS factor, subject, polarity FROM lo UNION ALL SELECT 1.5e0, subject, polarity FROM hi),
before AS (SELECT unnest([0.5e0, 1.5e0]) AS factor, subject, polarity FROM base)
SELECT *, 'added' AS change FROM (FROM after EXCEPT FROM before) UNION ALL SELECT *, 'removed' FROM (FROM before EXCEPT FROM after)""",
    "fu_sensitivity_single": f"""{_BASE}, {_sql('streams', '_lo', '0.5e0')}, {_sql('streams', '_hi', '1.5e0')}
SELECT v.stream_id, v.factor, CASE WHEN v.composite >= 0.5 THEN 'added' ELSE 'removed' END AS change
FROM (FROM composed_lo UNION ALL FROM composed_hi) v JOIN composed c USING (stream_id) WHERE v.half_life > 0 AND (v.composite >= 0.5) <> (c.composite >= 0.5)""",
    "fu_version_diff": f"""WITH {STREAMS}{_VERSIONS} SELECT coalesce(o.stream_id, n.stream_id) AS stream_id,
  CASE WHEN o.stream_id IS NULL THEN 'added' WHEN n.stream_id IS NULL THEN 'removed' ELSE 'retained' END AS state,
  CASE WHEN abs(o.confidence - n.confidence) > 1e-9 THEN 'confidence' ELSE '' END AS changed FROM old o FULL JOIN new n ON o.stream_id = n.stream_id""",
    "fu_synthesis": f"""WITH {STREAMS}{_VERSIONS}, {_sql('old', '_o')}, {_sql('new', '_n')}, a AS (SELECT subject, polarity FROM ({_CONCLUDE.format('composed_o')})), b AS (SELECT subject, polarity FROM ({_CONCLUDE.format('composed_n')}))
SELECT *, 'stable' AS state FROM (FROM a INTERSECT FROM b) UNION ALL SELECT *, 'new' FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'dropped' FROM (FROM a EXCEPT FROM b)""",
    "fu_synthesis_tiers": f"WITH {STREAMS}{_VERSIONS}, {_sql('new', '_n')} SELECT count(*) FILTER (WHERE composite >= 0.5) AS streams_used, min(source_tier) AS highest_tier, max(source_tier) AS lowest_tier FROM composed_n",
    "fu_feedback": """SELECT substr(sha256(event_id % 30 || '|u' || user_id || '|' || CASE WHEN event_id % 4 <> 0 THEN props ELSE '' END), 1, 16) AS stream_id, event_id % 30 AS subject, CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS claim,
  sha256(CASE WHEN event_id % 4 <> 0 THEN props ELSE '' END) AS provenance_hash, ts FROM events""",
    "fu_timeline": f"{_BASE} SELECT s.stream_id, s.ts, CASE WHEN s.claim = 'neutral' THEN 0e0 ELSE round(c.composite, 9) END AS score FROM streams s LEFT JOIN composed c USING (stream_id)",
}
