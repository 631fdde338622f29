"""Rule queries over events, documents, parts and nations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.operators import rules as op
from tallystone.session import table

POLICY = [
    {"id": "big", "verdict": "allow", "when": {"all": [{"field": "value", "op": "ge", "value": 30}, {"field": "event_type", "op": "in", "value": ["purchase", "view"]}]}},
    {"id": "errors", "verdict": "deny", "when": {"all": [{"field": "event_type", "op": "eq", "value": "error"}, {"not": {"field": "user_id", "op": "lt", "value": 20}}]}},
    {"id": "watch", "verdict": "escalate", "when": {"any": [{"field": "props", "op": "matches", "value": ".*: 1[0-9]?}"}, {"field": "props", "op": "contains", "value": "99"}]}},
    {"id": "rest", "verdict": "allow", "when": {"field": "event_type", "op": "ne", "value": "signup"}},
]
KEYWORDS = {"licence": ["license", "copyright"], "article": ["the "], "mail": ["@"]}


def ru_dsl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(op.condition(POLICY[2]["when"], e.schema)).select("event_id")


def ru_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 50 != 0, F.col("props")))
    return op.verdicts(e, POLICY).select("event_id", "verdict", "reason")


def _matches(spark, sf_dir):
    return op.keyword_matches(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), KEYWORDS, "doc_id")


def ru_keyword(spark, sf_dir):
    return _matches(spark, sf_dir)


def ru_node_conf(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1.0).when(F.col("doc_id") % 3 == 1, 0.7).otherwise(0.4).alias("weight"))
    return op.node_confidence(_matches(spark, sf_dir), w, "doc_id", {"licence": 0.9, "article": 0.6, "mail": 0.45})


def ru_conflict(spark, sf_dir):
    return op.shared_fact_conflicts(_matches(spark, sf_dir), "doc_id")


def ru_collapse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat("p_name", F.lit("  X"))).alias("text"))
    return op.collapsed(p, "p_brand", "text", "none")


def ru_guard(spark, sf_dir):
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " certainly so").when(F.col("turn") % 3 == 1, " is Guilty, certainly").otherwise(" guilts"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.guarded(text).alias("state"))


def _clocks(spark, sf_dir):
    i = F.col("event_id")
    clock = lambda *x: F.create_map(*(v for k, c in x for v in (F.lit(k), c.cast("long"))))
    return table(spark, sf_dir, "events").select("event_id", clock(("a", i % 3), ("b", i % 4)).alias("u"), clock(("b", i % 5), ("c", i % 2)).alias("v"))


def ru_vector_merge(spark, sf_dir):
    m = op.vector_merge(F.col("u"), F.col("v"))
    return _clocks(spark, sf_dir).select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


def ru_vector_order(spark, sf_dir):
    return _clocks(spark, sf_dir).select("event_id", op.vector_order(F.col("u"), F.col("v")).alias("relation"))


def ru_monotonic(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("version", F.col("event_id") % 11)
    return op.monotonic_faults(e, "user_id", "event_id", "version").select("event_id", "version", "before")


def ru_causality(spark, sf_dir):
    """Each event of a trace with its place by time, its predecessor and whether its id follows that one's."""
    e = table(spark, sf_dir, "events").withColumn("trace", F.col("event_id") % 500)
    w = W.partitionBy("trace").orderBy("ts", "event_id")
    out = e.select("trace", "event_id", F.row_number().over(w).alias("place"), F.lag("event_id").over(w).alias("predecessor"))
    return out.withColumn("follows", F.coalesce(F.col("event_id") > F.col("predecessor"), F.lit(True)))


def ru_strict(spark, sf_dir):
    """Verdicts by rules of which some compare values of different kinds."""
    rules = [
        {"id": "text_is_number", "verdict": "allow", "when": {"field": "event_type", "op": "eq", "value": 1}},
        {"id": "number_is_not_text", "verdict": "escalate", "when": {"all": [{"field": "value", "op": "ne", "value": "x"}, {"field": "user_id", "op": "in", "value": [3, "4", True, 5]}]}},
        {"id": "order_of_kinds", "verdict": "allow", "when": {"any": [{"field": "event_id", "op": "ge", "value": 5}, {"field": "flag", "op": "eq", "value": True}]}},
        {"id": "number_before_text", "verdict": "allow", "when": {"field": "kind", "op": "gt", "value": 7}},
        {"id": "no_such_field", "verdict": "allow", "when": {"not": {"field": "kind.inner", "op": "eq", "value": "a"}}},
    ]
    e = table(spark, sf_dir, "events").withColumn("flag", F.col("event_id") % 2 == 0).withColumn("kind", F.col("event_type"))
    first = op.verdicts(e, rules[:3]).select("event_id", "verdict", "reason")
    return first.unionByName(op.verdicts(e.where("event_id % 100 = 0"), [rules[2], rules[3]]).select(-F.col("event_id") - 1, "verdict", "reason").toDF("event_id", "verdict", "reason")).unionByName(
        op.verdicts(e.where("event_id % 100 = 1"), [rules[4]]).select(-F.col("event_id") - 1, "verdict", "reason").toDF("event_id", "verdict", "reason")
    )


def ru_overlap(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.array((F.col("n_nationkey") % 4).cast("string"), (F.col("n_nationkey") % 6 + 2).cast("string")).alias("scopes"))
    return op.overlaps(n.withColumnRenamed("n_name", "agent"))


def ru_forks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("decision"), F.array((F.col("event_id") % 90).cast("string"), (F.col("user_id") % 30).cast("string")).alias("deps"))
    return op.forks(e)


def ru_quality(spark, sf_dir):
    return op.quality_faults(table(spark, sf_dir, "documents"), "text", ["the"], 3000).select("doc_id", "faults")


def ru_gate(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_partkey") % 4 == 0).alias("ok"))
    return op.gate_outcome(a, "l_orderkey", "l_linenumber").select("l_orderkey", "attempts", "outcome")


def ru_neighbours(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("text"))
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 7 % 1999).alias("b"))
    return op.neighbours(edges, nodes, "red widget")


_WATCH = "(regexp_full_match(props, '.*: 1[0-9]?}') OR contains(props, '99'))"
_MATCHES = "m AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'licence' END, CASE WHEN contains(lower(text), 'the ') THEN 'article' END, CASE WHEN contains(lower(text), '@') THEN 'mail' END], lambda x: x IS NOT NULL)) AS rule FROM documents)"
_GREATEST = "greatest(event_id % 4, event_id % 5)"

QUERIES = {f.__name__: f for f in (
    ru_dsl, ru_verdict, ru_keyword, ru_node_conf, ru_conflict, ru_collapse, ru_guard, ru_vector_merge, ru_vector_order, ru_monotonic, ru_causality, ru_strict, ru_overlap, ru_forks, ru_quality, ru_gate, ru_neighbours,
)}

ORACLES = {
    "ru_dsl": f"SELECT event_id FROM events WHERE {_WATCH}",
    "ru_verdict": f"""WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN props END AS props) FROM events),
r AS (SELECT event_id, event_type = 'error' AND user_id >= 20 AS errors, props IS NULL AS lost, {_WATCH} AS watch, value >= 30 AND event_type IN ('purchase', 'view') AS big, event_type <> 'signup' AS rest FROM e)
SELECT event_id, CASE WHEN errors OR lost THEN 'deny' WHEN watch THEN 'escalate' WHEN big OR rest THEN 'allow' ELSE 'deny' END AS verdict,
  CASE WHEN errors THEN 'errors' WHEN lost THEN 'watch:missing_field' WHEN watch THEN 'watch' WHEN big THEN 'big' WHEN rest THEN 'rest' ELSE 'no_match' END AS reason FROM r""",
    "ru_keyword": f"WITH {_MATCHES} FROM m",
    "ru_node_conf": f"""WITH {_MATCHES}, g AS (SELECT rule, count(*) AS facts, least(CASE rule WHEN 'licence' THEN 0.9e0 WHEN 'article' THEN 0.6e0 ELSE 0.45e0 END, avg(CASE doc_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.7e0 ELSE 0.4e0 END)) AS c FROM m GROUP BY rule)
SELECT rule, facts, round_even(c, 4) AS confidence, CASE WHEN round_even(c, 4) < 0.5 THEN 'low' ELSE 'ok' END AS flag FROM g""",
    "ru_conflict": f"WITH {_MATCHES} SELECT a.rule, min(b.rule) AS conflicts_with FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.rule <> b.rule GROUP BY a.rule",
    "ru_collapse": "SELECT p_brand, coalesce(min(lower(p_name) || ' x') FILTER (WHERE p_size % 3 <> 0), 'none') AS text, count(*) FILTER (WHERE p_size % 3 = 0) AS dropped FROM part GROUP BY p_brand",
    "ru_guard": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'downgraded' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS state FROM conversations",
    "ru_vector_merge": f"SELECT event_id, event_id % 3 AS a, {_GREATEST} AS b, event_id % 2 AS c FROM events",
    "ru_vector_order": """WITH k AS (SELECT event_id, event_id % 3 <= 0 AND event_id % 4 <= event_id % 5 AS le, event_id % 4 >= event_id % 5 AND 0 >= event_id % 2 AS ge FROM events)
SELECT event_id, CASE WHEN le AND ge THEN 'equal' WHEN le THEN 'before' WHEN ge THEN 'after' ELSE 'concurrent' END AS relation FROM k""",
    "ru_monotonic": "WITH l AS (SELECT event_id, event_id % 11 AS version, coalesce(lag(event_id % 11) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM events) FROM l WHERE version <= before",
    "ru_causality": """WITH e AS (SELECT event_id % 500 AS trace, event_id, row_number() OVER w AS place, lag(event_id) OVER w AS predecessor FROM events WINDOW w AS (PARTITION BY event_id % 500 ORDER BY ts, event_id))
SELECT *, coalesce(event_id > predecessor, true) AS follows FROM e""",
    "ru_strict": """SELECT event_id, CASE WHEN user_id IN (3, 5) THEN 'escalate' WHEN event_id >= 5 OR event_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS verdict, CASE WHEN user_id IN (3, 5) THEN 'number_is_not_text' WHEN event_id >= 5 OR event_id % 2 = 0 THEN 'order_of_kinds' ELSE 'no_match' END AS reason FROM events
UNION ALL SELECT -event_id - 1, 'deny', 'number_before_text:missing_field' FROM events WHERE event_id % 100 = 0 UNION ALL SELECT -event_id - 1, 'deny', 'no_such_field:missing_field' FROM events WHERE event_id % 100 = 1""",
    "ru_overlap": """WITH s AS (SELECT DISTINCT n_name AS agent, unnest([n_nationkey % 4, n_nationkey % 6 + 2]) AS scope FROM nation)
SELECT x.agent AS a, y.agent AS b, string_agg(CAST(x.scope AS VARCHAR), ',' ORDER BY CAST(x.scope AS VARCHAR)) AS shared FROM s x JOIN s y ON x.scope = y.scope AND x.agent < y.agent GROUP BY ALL""",
    "ru_forks": "SELECT array_to_string(list_sort([CAST(event_id % 90 AS VARCHAR), CAST(user_id % 30 AS VARCHAR)]), ',') AS deps, count(*) AS decisions, min(event_id) AS first FROM events GROUP BY 1 HAVING count(*) > 1",
    "ru_quality": """SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN length(text) > 3000 THEN 'too_long' END,
CASE WHEN regexp_matches(text, '(?i)\\b(guaranteed|promise)\\b') THEN 'forbidden' END, CASE WHEN NOT contains(lower(coalesce(text, '')), 'the') THEN 'lacks_the' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents""",
    "ru_gate": """WITH a AS (SELECT l_orderkey, l_linenumber, bool_or(l_partkey % 4 = 0) AS ok FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, count(*) AS attempts, min(l_linenumber) FILTER (WHERE ok) AS f FROM a GROUP BY 1) SELECT l_orderkey, attempts, CASE WHEN f <= 2 THEN 'SHIP' WHEN f = 3 THEN 'ESCALATED' ELSE 'BLOCKED' END AS outcome FROM g""",
    "ru_neighbours": """WITH h AS (SELECT p_partkey AS node FROM part WHERE contains(p_name, 'red widget')), e AS (SELECT p_partkey AS a, p_partkey * 7 % 1999 AS b FROM part UNION ALL SELECT p_partkey * 7 % 1999, p_partkey FROM part)
SELECT node, 0 AS distance FROM h UNION ALL SELECT DISTINCT b, 1 FROM e WHERE a IN (FROM h) AND b NOT IN (FROM h)""",
}
