"""Placement queries over suppliers, orders, line items, nations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import placement as op
from tallystone.session import table


def _nodes(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("node"), (k % 17).alias("dt"), (k % 13).alias("tu"), (k * 37 % 140).alias("latency_ms"), (k * 91 % 1000).alias("capacity"), ((k * 29 % 100) / 100.0).alias("utilisation"),
        ((k * 13 % 100) / 100.0).alias("trust"), ((k * 7 % 10) / 10.0).alias("headroom"), F.array(F.concat(F.lit("t"), k % 5), F.concat(F.lit("t"), k % 7)).alias("tags"),
    )


def pl_best_node(spark, sf_dir):
    work = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 19).alias("dt"), (F.col("o_custkey") % 11).alias("tu"))
    return op.best_node(work, _nodes(spark, sf_dir), "o_orderkey")


def pl_route(spark, sf_dir):
    i = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select("event_id", F.array(F.concat(F.lit("t"), i % 6), F.concat(F.lit("t"), i % 4)).alias("needs"))
    return op.routed(jobs, _nodes(spark, sf_dir), "event_id")


def pl_division(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return op.division(li.select("l_suppkey", (F.col("l_partkey") % 40).alias("item")), spark.range(40).select(F.col("id").alias("item")), "l_suppkey", "item")


def pl_trust(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events")
    beats = e.select("user_id").distinct().select("user_id", F.array(F.concat(F.lit("c"), u % 4), F.concat(F.lit("c"), u % 7), F.lit("other")).alias("capabilities"))
    outcomes = e.where("user_id % 10 <> 0").select("user_id", (F.col("event_type") != "error").alias("ok"))
    return op.trust(beats, outcomes, "user_id", ["c0", "c1", "c2", "c3", "c5"])


def pl_standing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5 != 1).alias("valid"))
    return op.standing(e, "user_id", "event_id").select("event_id", "trust", "violations", "status")


def pl_available(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 41 % 500).alias("heard_s"))
    return op.available(nodes, nodes.where("node % 9 = 0"), F.lit(500), 300).select("node")


def pl_least_loaded(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("load"))
    return op.least_loaded(w.select((F.col("l_suppkey") % 8).alias("kind"), F.col("l_suppkey").alias("worker"), "load"), "kind", 620)


def pl_graph(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    states = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    return op.with_state(nodes, states)


def pl_undeclared(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("a"), (F.col("event_id") % 12).alias("b"))
    return op.undeclared(e, e.where("a % 2 = 0 OR b % 3 = 0").distinct())


def pl_versions(spark, sf_dir):
    return op.version_conflicts(table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 9).alias("version")), "p_brand", "version")


def _edges(spark, sf_dir):
    """Parts depend on a third and a fifth of their number; those that end in 99 close a ring."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"))
    down = p.where("b > 0").select(F.floor(F.col("b") / 3).alias("a"), "b").unionByName(p.where("b > 0").select(F.floor(F.col("b") / 5).alias("a"), "b"))
    ring = p.where("b % 100 = 99").select((F.col("b") * 3).alias("a"), "b")
    return down.unionByName(ring.join(p.select(F.col("b").alias("a")), "a", "left_semi"))


def pl_topo(spark, sf_dir):
    return op.reachable_depth(_edges(spark, sf_dir).where("a < b"))


def pl_cycle(spark, sf_dir):
    return op.cycles(_edges(spark, sf_dir))


def pl_rollup(spark, sf_dir):
    i = F.col("o_orderkey")
    leaves = table(spark, sf_dir, "orders").select(F.concat_ws("/", i % 5, i % 15, i).alias("path"), (i % 15 < 9).alias("ok"), (i % 700 == 1).alias("failed"))
    return op.tree_rollup(leaves)


def pl_gates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_name", "p_partkey").alias("proposal"), F.col("p_type").alias("kind"))
    return op.gate_order(p, {"ECONOMY": 1, "SMALL": 2}).select("proposal", "priority", "derived")


def pl_urgency(spark, sf_dir):
    j = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 900 - 40).alias("target_ms"))
    return op.urgency(j, 50).select("job", F.round("urgency", 9).alias("urgency"))


def pl_due(spark, sf_dir):
    return op.due(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 97).alias("due")), 13)


def pl_ingress(spark, sf_dir):
    i = F.col("event_id")
    cases = table(spark, sf_dir, "events").select("event_id", ((i % 100) / 100.0).alias("threat"), F.col("value").alias("cost_j"), F.when(i % 7 != 0, i % 90).alias("remaining_j"), F.lit(100.0).alias("budget_j"))
    return op.ingress(cases).select("event_id", "verdict")


def pl_egress(spark, sf_dir):
    i = F.col("event_id")
    cases = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, "classified").otherwise("open").alias("sensitivity"), (i % 5).alias("destination"), (i % 2).alias("node"), (i % 14).alias("chain_length"))
    return op.egress(cases, "node").select("event_id", "verdict", "reason")


def pl_torque(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 6).alias("frame"), (1.0 + k * 17 % 40).alias("priority"), (0.5 + k % 3 / 10.0).alias("efficiency"), F.when((k % 11 == 0) | (k % 6 == 5), 0.0).otherwise(0.1 + k % 9 / 10.0).alias("requested"))
    return op.torque(s, "frame", 4.0, 0.05).select("s_suppkey", F.round("share", 6).alias("share"), F.round("banked", 6).alias("banked"))


def pl_model(spark, sf_dir):
    m = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("vertical"), F.col("p_partkey").alias("model"), (F.col("p_partkey") % 3).alias("tier")).where("NOT (vertical = 4 AND tier = 1)")
    req = m.select("vertical").distinct().select("vertical", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("tier"))
    return op.select_model(m, req)


def pl_treaties(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("treaty"), F.col("l_linenumber").alias("party"), "l_quantity")
    return op.active_treaties(p.select("treaty", "party").distinct(), p.where("l_quantity > 12").select("treaty", "party").distinct())


def pl_vram(spark, sf_dir):
    return op.vram_fit(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 53 % 97).alias("free")), 96)


_NODES = "n AS (SELECT s_suppkey AS node, s_suppkey % 17 AS dt, s_suppkey % 13 AS tu, 0.3e0 * greatest(0e0, 1e0 - (s_suppkey * 37 % 140) / 100e0) + 0.5e0 * ((s_suppkey * 91 % 1000) / 1000e0) - 0.2e0 * ((s_suppkey * 29 % 100) / 100e0) AS score, (s_suppkey * 13 % 100) / 100e0 AS trust, (s_suppkey * 7 % 10) / 10e0 AS headroom, ['t' || s_suppkey % 5, 't' || s_suppkey % 7] AS tags FROM supplier)"
_EDGES = """p AS (SELECT p_partkey AS b FROM part), e AS (SELECT b // 3 AS a, b FROM p WHERE b > 0
UNION ALL SELECT b // 5, b FROM p WHERE b > 0 UNION ALL SELECT b * 3, b FROM p WHERE b % 100 = 99 AND b * 3 IN (FROM p))"""

QUERIES = {f.__name__: f for f in (
    pl_best_node, pl_route, pl_division, pl_trust, pl_standing, pl_available, pl_least_loaded, pl_graph, pl_undeclared, pl_versions, pl_topo, pl_cycle, pl_rollup, pl_gates, pl_urgency, pl_due, pl_ingress, pl_egress, pl_torque, pl_model, pl_treaties, pl_vram,
)}

ORACLES = {
    "pl_best_node": f"WITH {_NODES} SELECT o_orderkey, (SELECT node FROM n WHERE dt >= o_orderkey % 19 AND tu >= o_custkey % 11 ORDER BY score DESC, node LIMIT 1) AS node FROM orders",
    "pl_route": f"""WITH {_NODES}, k AS (SELECT DISTINCT event_id % 12 AS kind, ['t' || event_id % 6, 't' || event_id % 4] AS needs FROM events),
r AS (SELECT kind, node, row_number() OVER (PARTITION BY kind ORDER BY round_even(trust * 0.5e0 + len(list_intersect(needs, tags)) / 2e0 * 0.3e0 + headroom * 0.2e0, 9) DESC, node) AS r FROM k JOIN n ON list_has_any(needs, tags)),
c AS (SELECT kind, string_agg(node, '>' ORDER BY r) AS chain FROM r WHERE r <= 3 GROUP BY kind) SELECT event_id, chain FROM events JOIN c ON kind = event_id % 12""",
    "pl_division": "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey % 40) = 40",
    "pl_trust": """WITH r AS (SELECT user_id, avg(CAST(event_type <> 'error' AS INTEGER)) AS rate FROM events WHERE user_id % 10 <> 0 GROUP BY 1), u AS (SELECT DISTINCT user_id, list_intersect(['c' || user_id % 4, 'c' || user_id % 7], ['c0', 'c1', 'c2', 'c3', 'c5']) AS met FROM events)
SELECT user_id, round_even(0.4e0 * coalesce(rate, 0.5e0) + 0.3e0 + 0.3e0 * (len(list_distinct(met)) / 5e0), 4) AS trust FROM u LEFT JOIN r USING (user_id)""",
    "pl_standing": """WITH s AS (SELECT event_id, round_even(avg(CAST(event_id % 5 <> 1 AS INTEGER)) OVER w, 4) AS trust, count(*) FILTER (WHERE event_id % 5 = 1) OVER w AS violations FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, trust, violations, CASE WHEN violations >= 3 THEN 'BANNED' WHEN violations >= 1 AND trust < 0.5 THEN 'SUSPECT' ELSE 'HEALTHY' END AS status FROM s""",
    "pl_available": "SELECT s_suppkey AS node FROM supplier WHERE 500 - s_suppkey * 41 % 500 <= 300 AND s_suppkey % 9 <> 0",
    "pl_least_loaded": "WITH w AS (SELECT l_suppkey, count(*) AS load FROM lineitem GROUP BY 1) SELECT l_suppkey % 8 AS kind, l_suppkey AS worker FROM w WHERE load < 620 QUALIFY row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY load, l_suppkey) = 1",
    "pl_graph": "SELECT c_custkey AS node, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'unknown') AS state FROM customer",
    "pl_undeclared": "SELECT DISTINCT user_id % 30 AS a, event_id % 12 AS b FROM events WHERE user_id % 30 % 2 <> 0 AND event_id % 12 % 3 <> 0",
    "pl_versions": "SELECT p_brand, count(DISTINCT p_size % 9) AS versions, min(p_size % 9) AS least, max(p_size % 9) AS most FROM part GROUP BY p_brand HAVING count(DISTINCT p_size % 9) > 1",
    "pl_topo": f"WITH RECURSIVE {_EDGES}, d AS (SELECT 0 AS node, 0 AS depth UNION SELECT e.b, d.depth + 1 FROM d JOIN e ON e.a = d.node AND e.a < e.b) SELECT node, max(depth) AS depth FROM d GROUP BY node",
    "pl_cycle": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), on_cycle AS (SELECT DISTINCT a FROM r WHERE a = b)
SELECT a AS node FROM on_cycle UNION SELECT b FROM r WHERE a IN (FROM on_cycle)""",
    "pl_rollup": """WITH l AS (SELECT o_orderkey AS i FROM orders), p AS (SELECT CAST(i % 5 AS VARCHAR) AS path, i FROM l UNION ALL SELECT i % 5 || '/' || i % 15, i FROM l UNION ALL SELECT i % 5 || '/' || i % 15 || '/' || i, i FROM l)
SELECT path, CASE WHEN bool_or(i % 700 = 1) THEN 'failed' WHEN bool_and(i % 15 < 9) THEN 'done' ELSE 'open' END AS state, count(*) AS leaves FROM p GROUP BY path""",
    "pl_gates": "SELECT p_name || '-' || p_partkey AS proposal, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 ELSE 99 END AS priority, CAST('0x' || substr(sha256(p_name || '-' || p_partkey), 1, 12) AS BIGINT) AS derived FROM part",
    "pl_urgency": """WITH j AS (SELECT o_orderkey AS job, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 1000e0 + CASE WHEN o_custkey % 900 - 40 <= 0 THEN 0e0 ELSE 1e0 / (o_custkey % 900 - 40) END AS u FROM orders WHERE o_orderstatus = 'P')
SELECT job, round(u, 9) AS urgency FROM j ORDER BY u, job LIMIT 50""",
    "pl_due": "SELECT o_orderkey AS job, o_custkey % 97 AS due FROM orders WHERE o_custkey % 97 <= 13 ORDER BY due, job LIMIT 100",
    "pl_ingress": "SELECT event_id, CASE WHEN event_id % 100 >= 70 THEN 'quarantine' WHEN event_id % 7 <> 0 AND event_id % 90 < value AND event_id % 90 < 30 THEN 'defer' ELSE 'permit' END AS verdict FROM events",
    "pl_egress": """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> event_id % 2 THEN 'classified_to_external' WHEN event_id % 14 > 10 THEN 'provenance_chain_too_long' END AS reason FROM events)
SELECT event_id, CASE WHEN reason IS NULL THEN 'permit' ELSE 'reject' END AS verdict, reason FROM r""",
    "pl_torque": """WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS f, (1e0 + s_suppkey * 17 % 40) * (0.5e0 + s_suppkey % 3 / 10e0) * q AS w, q FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 6 = 5 THEN 0e0 ELSE 0.1e0 + s_suppkey % 9 / 10e0 END AS q FROM supplier)),
r AS (SELECT *, CASE WHEN q > 0 AND sum(w) OVER g > 1e-6 THEN w / sum(w) OVER g * 4 END AS raw FROM s WINDOW g AS (PARTITION BY f)),
x AS (SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(raw, 0.05e0) END AS lifted, sum(greatest(0.05e0 - raw, 0)) OVER g AS extra, sum(greatest(raw - 0.05e0, 0)) OVER g AS spare FROM r WINDOW g AS (PARTITION BY f)),
m AS (SELECT *, least(1e0, coalesce(CASE WHEN extra <= 1e-6 THEN lifted WHEN spare >= extra THEN lifted - (lifted - 0.05e0) * extra / spare ELSE lifted * (4 / (4 + extra)) END, 0)) AS share FROM x)
SELECT s_suppkey, round(CASE WHEN sum(share) OVER g > 4 THEN share * 4 / sum(share) OVER g ELSE share END, 6) AS share, round(greatest(0, 4 - least(4, sum(share) OVER g)), 6) AS banked FROM m WINDOW g AS (PARTITION BY f)""",
    "pl_model": """WITH m AS (SELECT p_size % 10 AS vertical, p_partkey AS model, p_partkey % 3 AS tier FROM part WHERE NOT (p_size % 10 = 4 AND p_partkey % 3 = 1)), q AS (SELECT DISTINCT vertical, unnest([0, 1, 2]) AS tier FROM m)
SELECT vertical, CAST(q.tier AS BIGINT) AS tier, coalesce(min(model) FILTER (WHERE m.tier = q.tier), min(model)) AS model FROM q JOIN m USING (vertical) GROUP BY vertical, q.tier""",
    "pl_treaties": "WITH p AS (SELECT l_orderkey AS treaty, l_linenumber, bool_or(l_quantity > 12) AS signed FROM lineitem GROUP BY ALL) SELECT treaty FROM p GROUP BY treaty HAVING bool_and(signed)",
    "pl_vram": "SELECT s_suppkey AS node, CASE WHEN s_suppkey * 53 % 97 >= 96 THEN 'full' WHEN s_suppkey * 53 % 97 > 0 THEN 'partial' ELSE 'none' END AS fit FROM supplier ORDER BY s_suppkey * 53 % 97 DESC, s_suppkey DESC LIMIT 1",
}
