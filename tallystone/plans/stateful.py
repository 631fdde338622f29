"""Queries of state machines, byte statistics and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import forensics, vectors
from tallystone.operators import stateful as op
from tallystone.session import table


def _ticks(spark, sf_dir):
    """Events with the hour since the start of 2024 as tick."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("tick", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("long"))


def st_pressure(spark, sf_dir):
    s = _ticks(spark, sf_dir).select((F.col("tick") % 24).alias("tick"), (F.col("user_id") % 4).alias("site"), F.col("event_type").alias("reason"), (F.col("event_id") % 41 - 5).alias("value"))
    return op.pressure(s, "site").select("tick", "site", "total", "dominant", "level")


def st_hysteresis(spark, sf_dir):
    return op.debounced(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_id") % 5 < 3, 3, 2).select("event_id", "state")


def st_lease(spark, sf_dir):
    act = F.when(F.col("event_type") == "signup", "grant").when(F.col("event_type") == "error", "revoke").otherwise("use")
    return op.leases(_ticks(spark, sf_dir).withColumn("act", act), "user_id", "event_id", "tick", 24).select("event_id", "held")


def st_admission(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 9 == 0, "critical").otherwise("normal").alias("level"), (i % 7).alias("credits"), (i % 50).alias("deadline"), (i % 45).alias("tick"), F.when(i % 4 != 0, i % 4).alias("node"))
    return op.admission(rows).select("event_id", "decision")


def st_eligible(spark, sf_dir):
    k = F.col("s_suppkey")
    panels = table(spark, sf_dir, "supplier").select(k.alias("panel"), F.create_map(F.lit("zone"), (k % 4).cast("string"), F.lit("kind"), (k % 3).cast("string")).alias("tags"))
    jobs = table(spark, sf_dir, "events").select(F.create_map(F.lit("zone"), (F.col("event_id") % 5).cast("string"), F.lit("kind"), (F.col("event_id") % 3).cast("string")).alias("needs"))
    # Maps can't be grouped; their text can.
    kinds = jobs.select(F.to_json("needs").alias("j")).distinct().select(F.from_json("j", "map<string,string>").alias("needs"))
    pairs = op.eligible(kinds, panels)
    return pairs.groupBy("panel").agg(F.count(F.lit(1)).alias("n_needs"))


def st_round_robin(spark, sf_dir):
    return op.round_robin(table(spark, sf_dir, "events"), "user_id", "event_id", 7).select("event_id", "slot")


def st_token_bucket(spark, sf_dir):
    return op.token_bucket(_ticks(spark, sf_dir).withColumn("cost", 4 + F.col("event_id") % 9), "user_id", "event_id", "tick", "cost", 20, 1).select("event_id", "accepted", "tokens")


def st_epoch_budget(spark, sf_dir):
    e = _ticks(spark, sf_dir).select(F.col("user_id").alias("epoch"), "event_id", (F.col("event_id") % 40).alias("unit"), (1 + F.col("event_id") % 13).alias("cost"))
    return op.epoch_budget(e, "epoch", "event_id", "unit", "cost", 90).select("event_id", "result", "spent")


def st_capacity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 < 2, "start").otherwise("end").alias("act"), (F.col("event_id") % 5 + 1).alias("need_dt"), (F.col("event_id") % 4).alias("need_tu"))
    return op.capacity_gate(e, "user_id", "event_id", 10, 8, 3).select("event_id", "result", "used_dt", "used_tu")


def st_gear(spark, sf_dir):
    return op.gear(_ticks(spark, sf_dir).withColumn("load", (F.col("event_id") * 37 % 100) / 100.0), "user_id", "event_id", "tick", "load", cooldown=12).select("event_id", "gear")


def st_dedup_window(spark, sf_dir):
    return op.recent_duplicates(table(spark, sf_dir, "events").withColumn("fp", F.concat_ws("-", "event_type", F.floor(F.col("value") / 20))), "user_id", "event_id", "fp", 6).select("event_id", "duplicate")


def st_circuit(spark, sf_dir):
    return op.circuit(_ticks(spark, sf_dir).withColumn("ok", F.col("event_id") % 5 == 0), "user_id", "event_id", "tick", "ok", 3, 30).select("event_id", "circuit")


def st_jobs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") % 4).alias("p"))
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).cast("long").alias("tick"), F.when(F.col("p") == 0, "ok").otherwise("fail").alias("outcome"))
    return op.job_lifecycle(rows, "l_orderkey", "l_linenumber", "tick", "outcome", 2, 45).select("l_orderkey", "l_linenumber", "state", "due")


def st_ttl(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("sent"), (F.col("event_id") % 500 + F.col("user_id") % 90).alias("received"))
    return op.live_messages(m, 500, 300).select("event_id")


def st_stage_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") % 5).alias("p"))
    rows = li.withColumn("status", F.when(F.col("p") < 3, "complete").when(F.col("p") == 3, "running").otherwise("pending"))
    return op.stage_faults(rows, "l_orderkey", "l_linenumber", "status").select("l_orderkey", "l_linenumber")


def st_intake(spark, sf_dir):
    a = F.when(F.col("event_id") % 11 == 0, F.array(F.lit("low"), F.lit("critical"))).when(F.col("event_id") % 5 == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    return op.intake(table(spark, sf_dir, "events").select("event_id", a.alias("anomalies"))).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def st_sessions(spark, sf_dir):
    """Sessions of a user's events, apart by more than six hours."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def nm_weighted_conf(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("text"), (F.col("p_partkey") * 31 % 101).cast("double").alias("confidence"))
    return forensics.page_confidence(w, "p_brand").withColumn("confidence", F.round("confidence", 6))


def nm_entropy(spark, sf_dir):
    return forensics.byte_statistics(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text").select("id", "n_bytes", F.round("entropy", 6).alias("entropy"), F.round("pair_chi2", 4).alias("pair_chi2"))


def nm_obstruction(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<script")).alias("n_scripts"), F.regexp_count("html", F.lit("<img")).alias("n_images"), (F.col("page_id") % 9 == 0).alias("encrypted"), (F.col("page_id") % 120).alias("text_chars"))
    return forensics.obstruction(p).select("page_id", "score")


def ve_chunks(spark, sf_dir):
    return vectors.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n", "words", "chunk_id")


def ve_new_chunks(spark, sf_dir):
    c = vectors.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return vectors.new_chunks(c, c.where("doc_id % 3 <> 0")).select("doc_id", "n")


def _nearest(spark, sf_dir, metric):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(v, v.where("vec_id % 20 = 0"), 5, metric).withColumn("distance", F.round("distance", 6))


def ve_knn_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, "l2")


def ve_knn_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir, "cosine")


_T = "t AS (SELECT *, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS tick, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
_STEP = "FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1"

QUERIES = {f.__name__: f for f in (
    st_pressure, st_hysteresis, st_lease, st_admission, st_eligible, st_round_robin, st_token_bucket, st_epoch_budget, st_capacity, st_gear, st_dedup_window, st_circuit, st_jobs, st_ttl, st_stage_gate, st_intake, st_sessions, nm_weighted_conf, nm_entropy, nm_obstruction, ve_chunks, ve_new_chunks, ve_knn_l2, ve_knn_cosine,
)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda w: w <> '')"
_CHUNKS = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 270)) AS since FROM w WHERE len(w) > 0), k AS (SELECT doc_id, CAST(since // 270 AS INTEGER) AS n, w[since + 1 : since + 300] AS w FROM c)"
_JOBS = "j AS (SELECT l_orderkey, l_linenumber, max(l_partkey % {0}) AS p FROM lineitem GROUP BY ALL)"


def _knn(distance: str) -> str:
    return f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {distance} AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM d QUALIFY rank <= 5"""


ORACLES = {
    "st_pressure": f"""WITH {_T}, r AS (SELECT tick % 24 AS tick, user_id % 4 AS site, event_type AS reason, CAST(sum(event_id % 41 - 5) AS BIGINT) AS v FROM t WHERE event_id % 41 > 5 GROUP BY ALL)
SELECT tick, site, CAST(sum(v) AS BIGINT) AS total, max_by(reason, (v, reason)) AS dominant, CASE WHEN sum(v) >= 0.95 THEN 'critical' ELSE 'normal' END AS level FROM r GROUP BY ALL""",
    "st_hysteresis": """WITH RECURSIVE t AS (SELECT event_id, user_id, event_id % 5 < 3 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, CASE WHEN high THEN 1 ELSE 0 END AS ups, CASE WHEN high THEN 0 ELSE 1 END AS downs, false AS state FROM t WHERE n = 1
UNION ALL SELECT t.user_id, t.n, t.event_id, CASE WHEN t.high THEN ups + 1 ELSE 0 END, CASE WHEN t.high THEN 0 ELSE downs + 1 END, CASE WHEN t.high AND ups + 1 >= 3 THEN true WHEN NOT t.high AND downs + 1 >= 2 THEN false ELSE state END FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
SELECT event_id, state FROM f""",
    "st_lease": f"""WITH {_T} SELECT event_id, coalesce((SELECT p.event_type = 'signup' AND t.tick - p.tick <= 24 FROM t p WHERE p.user_id = t.user_id AND p.event_id <= t.event_id AND p.event_type IN ('signup', 'error') ORDER BY p.event_id DESC LIMIT 1), false) AS held FROM t""",
    "st_admission": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'reject_pressure' WHEN event_id % 7 = 0 THEN 'reject_credit' WHEN event_id % 50 < event_id % 45 THEN 'reject_deadline' WHEN event_id % 4 = 0 THEN 'defer' ELSE 'admit' END AS decision FROM events",
    "st_eligible": "WITH n AS (SELECT DISTINCT event_id % 5 AS z, event_id % 3 AS k FROM events) SELECT s_suppkey AS panel, count(*) AS n_needs FROM supplier JOIN n ON z = s_suppkey % 4 AND k = s_suppkey % 3 GROUP BY 1",
    "st_round_robin": "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 7 AS INTEGER) AS slot FROM events",
    "st_capacity": f"""WITH RECURSIVE {_T}, x AS (SELECT user_id, n, event_id, event_id % 3 < 2 AS start, event_id % 5 + 1 AS a, event_id % 4 AS b FROM t),
z AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS dt, CAST(0 AS BIGINT) AS tu, 0 AS waiting, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS running, '' AS result FROM x WHERE n = 1
UNION ALL SELECT x.user_id, x.n, x.event_id, CASE WHEN start AND dt + a <= 10 AND tu + b <= 8 THEN dt + a WHEN NOT start AND len(running) > 0 THEN dt - running[1].a ELSE dt END,
  CASE WHEN start AND dt + a <= 10 AND tu + b <= 8 THEN tu + b WHEN NOT start AND len(running) > 0 THEN tu - running[1].b ELSE tu END,
  CASE WHEN start AND NOT (dt + a <= 10 AND tu + b <= 8) AND waiting < 3 THEN waiting + 1 WHEN NOT start AND len(running) > 0 THEN greatest(0, waiting - 1) ELSE waiting END,
  CASE WHEN start AND dt + a <= 10 AND tu + b <= 8 THEN list_append(running, {{'a': a, 'b': b}}) WHEN NOT start THEN running[2:] ELSE running END,
  CASE WHEN start THEN CASE WHEN dt + a <= 10 AND tu + b <= 8 THEN 'run' WHEN waiting < 3 THEN 'wait' ELSE 'reject' END WHEN len(running) > 0 THEN 'release' ELSE 'idle' END
FROM z JOIN x ON x.user_id = z.user_id AND x.n = z.n + 1) SELECT event_id, result, dt AS used_dt, tu AS used_tu FROM z WHERE n > 0""",
    "st_jobs": """WITH RECURSIVE j AS (SELECT l_orderkey, l_linenumber, max(l_partkey % 4) = 0 AS ok, CAST(l_linenumber * 10 AS BIGINT) AS tick, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
z AS (SELECT l_orderkey, n, l_linenumber, tick AS first, CASE WHEN ok THEN 0 ELSE 1 END AS tries, ok AS over, CASE WHEN ok THEN 'done' ELSE 'retry' END AS state, CASE WHEN ok THEN 0 ELSE tick + 2 END AS due FROM j WHERE n = 1
UNION ALL SELECT j.l_orderkey, j.n, j.l_linenumber, first, CASE WHEN over OR tick - first > 45 OR ok OR tries >= 2 THEN tries ELSE tries + 1 END, over OR tick - first > 45 OR ok OR tries >= 2,
  CASE WHEN over THEN 'archived' WHEN tick - first > 45 THEN 'timed_out' WHEN ok THEN 'done' WHEN tries >= 2 THEN 'failed' ELSE 'retry' END,
  CASE WHEN over OR tick - first > 45 OR ok OR tries >= 2 THEN 0 ELSE tick + (2 << tries) END FROM z JOIN j ON j.l_orderkey = z.l_orderkey AND j.n = z.n + 1)
SELECT l_orderkey, l_linenumber, state, CAST(due AS BIGINT) AS due FROM z""",
    "st_token_bucket": f"""WITH RECURSIVE {_T}, f AS (SELECT user_id, n, event_id, tick, 'yes' AS accepted, 20 - (4 + event_id % 9) AS tokens FROM t WHERE n = 1
UNION ALL SELECT t.user_id, t.n, t.event_id, t.tick, CASE WHEN least(20, tokens + t.tick - f.tick) >= 4 + t.event_id % 9 THEN 'yes' ELSE 'no' END,
  least(20, tokens + t.tick - f.tick) - CASE WHEN least(20, tokens + t.tick - f.tick) >= 4 + t.event_id % 9 THEN 4 + t.event_id % 9 ELSE 0 END {_STEP}) SELECT event_id, accepted, tokens FROM f""",
    "st_epoch_budget": f"""WITH RECURSIVE {_T}, f AS (SELECT user_id, n, event_id, [event_id % 40] AS seen, 1 + event_id % 13 AS spent, 'taken' AS result FROM t WHERE n = 1
UNION ALL SELECT t.user_id, t.n, t.event_id, CASE WHEN list_contains(seen, t.event_id % 40) OR spent + 1 + t.event_id % 13 > 90 THEN seen ELSE list_append(seen, t.event_id % 40) END,
  CASE WHEN list_contains(seen, t.event_id % 40) OR spent + 1 + t.event_id % 13 > 90 THEN spent ELSE spent + 1 + t.event_id % 13 END,
  CASE WHEN list_contains(seen, t.event_id % 40) THEN 'duplicate' WHEN spent + 1 + t.event_id % 13 > 90 THEN 'over' ELSE 'taken' END {_STEP}) SELECT event_id, result, spent FROM f""",
    "st_gear": f"""WITH RECURSIVE {_T}, x AS (SELECT *, (event_id * 37 % 100) / 100e0 AS load FROM t),
z AS (SELECT user_id, 0 AS n, NULL::BIGINT AS event_id, 1 AS gear, NULL::BIGINT AS since FROM x WHERE n = 1
UNION ALL SELECT x.user_id, x.n, x.event_id, CASE WHEN load >= 0.97 THEN 4 WHEN since IS NULL OR tick - since >= 12 THEN CASE WHEN load > 0.8 THEN least(4, gear + 1) WHEN load < 0.3 THEN greatest(1, gear - 1) ELSE gear END ELSE gear END,
  CASE WHEN (CASE WHEN load >= 0.97 THEN 4 WHEN since IS NULL OR tick - since >= 12 THEN CASE WHEN load > 0.8 THEN least(4, gear + 1) WHEN load < 0.3 THEN greatest(1, gear - 1) ELSE gear END ELSE gear END) <> gear THEN tick ELSE since END
FROM z JOIN x ON x.user_id = z.user_id AND x.n = z.n + 1) SELECT event_id, CAST(gear AS INTEGER) AS gear FROM z WHERE n > 0""",
    "st_dedup_window": f"""WITH RECURSIVE {_T}, x AS (SELECT *, event_type || '-' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS fp FROM t), z AS (SELECT user_id, n, event_id, [fp] AS seen, false AS duplicate FROM x WHERE n = 1
UNION ALL SELECT x.user_id, x.n, x.event_id, CASE WHEN list_contains(seen, fp) THEN seen ELSE list_append(seen, fp)[greatest(1, len(seen) - 4) :] END, list_contains(seen, fp) FROM z JOIN x ON x.user_id = z.user_id AND x.n = z.n + 1) SELECT event_id, duplicate FROM z""",
    "st_circuit": f"""WITH RECURSIVE {_T}, z AS (SELECT user_id, 0 AS n, NULL::BIGINT AS event_id, 'closed' AS circuit, 0 AS bad, 0::BIGINT AS since FROM t WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN c = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN c = 'half_open' OR bad + 1 >= 3 THEN 'open' ELSE c END,
  CASE WHEN c = 'open' THEN bad WHEN ok OR c = 'half_open' OR bad + 1 >= 3 THEN 0 ELSE bad + 1 END, CASE WHEN c <> 'open' AND NOT ok AND (c = 'half_open' OR bad + 1 >= 3) THEN tick ELSE since END
FROM (SELECT t.user_id, t.n, t.event_id, t.tick, t.event_id % 5 = 0 AS ok, bad, since, CASE WHEN circuit = 'open' AND t.tick - since >= 30 THEN 'half_open' ELSE circuit END AS c FROM z JOIN t ON t.user_id = z.user_id AND t.n = z.n + 1)) SELECT event_id, circuit FROM z WHERE n > 0""",
    "st_ttl": "SELECT event_id FROM events WHERE 500 - event_id % 500 <= 300 AND user_id % 90 <= 60",
    "st_stage_gate": f"WITH {_JOBS.format(5)}, l AS (SELECT *, lag(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM j) SELECT l_orderkey, l_linenumber FROM l WHERE p <= 3 AND b >= 3",
    "st_intake": "SELECT CASE WHEN event_id % 11 = 0 THEN 'quarantine' WHEN event_id % 5 = 0 THEN 'review' ELSE 'clean' END AS gate, count(*) AS n FROM events GROUP BY 1",
    "st_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "nm_weighted_conf": """WITH w AS (SELECT p_brand, greatest(length(p_name), 1) AS w, CAST(p_partkey * 31 % 101 AS DOUBLE) AS c FROM part),
g AS (SELECT p_brand, sum(w * c) / sum(w) AS c, count(*) FILTER (WHERE c > 90) / count(*) AS high, count(*) FILTER (WHERE c < 30) / count(*) AS low FROM w GROUP BY 1)
SELECT p_brand, round(c, 6) AS confidence, CASE WHEN c >= 80 THEN 'PASS' WHEN c >= 50 THEN 'REVIEW' ELSE 'FAIL' END AS band, high > 0.4 AND low > 0.3 AS bimodal FROM g""",
    "nm_entropy": """WITH b AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM conversations), c AS (SELECT id, x, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT id, CAST('0x' || x AS INTEGER) // 2 AS pair, sum(c) AS t, sum(CASE WHEN CAST('0x' || x AS INTEGER) % 2 = 0 THEN c ELSE -c END) AS d FROM c GROUP BY ALL),
n AS (SELECT id, sum(c) AS n FROM c GROUP BY id), h AS (SELECT id, CAST(any_value(n) AS BIGINT) AS n_bytes, -sum(c / n * log2(c / n)) AS entropy FROM c JOIN n USING (id) GROUP BY id)
SELECT id, n_bytes, round(entropy, 6) AS entropy, round((SELECT sum(d * d / t) FROM p WHERE p.id = h.id), 4) AS pair_chi2 FROM h""",
    "nm_obstruction": "SELECT page_id, least(100, CASE WHEN page_id % 9 = 0 THEN 40 ELSE 0 END + least(30, 10 * len(regexp_extract_all(html, '<script'))) + CASE WHEN contains(html, '<img') AND page_id % 120 = 0 THEN 35 ELSE 0 END + CASE WHEN page_id % 120 < 50 THEN 10 ELSE 0 END) AS score FROM pages",
    "ve_chunks": f"WITH {_CHUNKS} SELECT doc_id, n, len(w) AS words, sha256(doc_id || ':' || n || ':' || sha256(array_to_string(w, ' '))) AS chunk_id FROM k",
    "ve_new_chunks": f"WITH {_CHUNKS} SELECT doc_id, n FROM k WHERE doc_id % 3 = 0",
    "ve_knn_l2": _knn("list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"),
    "ve_knn_cosine": _knn("1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"),
}
