"""Queries on nested JSON, beside their SQL. Payloads are written from ``conversations`` by the same rule in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import nested as op
from tallystone.session import table

TOP = ["verdict", "ruling"]
ANYWHERE = ["blame", "guilt"]
PHRASES = ["beyond doubt", "is proven"]


def _c(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _left():
    p, n = F.col("pos"), F.length("text")
    return _text('{"id":', p, ',"who":{"role":"', F.col("role"), '","rank":', p % 7, '},"marks":[', n % 5, ",", n % 11, ',{"deep":[', n % 3, ']}],"size":', n, ',"note":null}')


def _right():
    p, n = F.col("pos"), F.length("text")
    role = F.when(p % 9 == 4, "editor").otherwise(F.col("role"))
    more = F.when(p % 13 == 5, ',"extra":{"why":["late"]}').otherwise("")
    return _text('{"size":', n, ',"marks":[', n % 5, ",", n % 11, ',{"deep":[', F.when(p % 17 == 3, '9,"x"').otherwise((n % 3).cast("string")), ']}],"who":{"rank":', p % 7, ',"role":"', role, '"},"id":', p, more, F.when(p % 19 != 2, ',"note":null').otherwise(""), "}")


def _sides(spark, sf_dir):
    c = _c(spark, sf_dir)
    return c.where("pos % 23 <> 1").select("pos", _left().alias("payload")), c.where("pos % 29 <> 1").select("pos", _right().alias("payload"))


def ch_ingest_diff(spark, sf_dir):
    return op.ingest_diff(*_sides(spark, sf_dir))


def ch_key_sets(spark, sf_dir):
    return op.key_sets(*_sides(spark, sf_dir)).select("pos", F.array_join("only_left", ",").alias("only_left"), F.array_join("only_right", ",").alias("only_right"))


def ch_ingest_verdict(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    runs = left.agg(F.lit("left").alias("side"), F.count(F.lit(1)).alias("ingested"), F.lit(True).alias("verified")).unionByName(right.agg(F.lit("right").alias("side"), F.count(F.lit(1)).alias("ingested"), F.lit(True).alias("verified")))
    return op.ingest_verdict(op.ingest_diff(left, right), runs)


def _envelopes(spark, sf_dir):
    """Every second envelope has its names in another order and another evaluator; every fifth a list turned round."""
    p, n = F.col("pos"), F.length("text")
    list_ = F.when(p % 5 == 0, _text("[", n % 3, ",7]")).otherwise(_text("[7,", n % 3, "]"))
    one = _text('{"case":{"a":', n % 4, ',"b":', list_, '},"role":"', F.col("role"), '","evaluator":{"v":', p, "}}")
    other = _text('{"role":"', F.col("role"), '","case":{"b":', list_, ',"a":', n % 4, '},"evaluator":"', p % 3, '"}')
    return _c(spark, sf_dir).select("pos", F.when(p % 2 == 0, one).otherwise(other).alias("payload"))


def ru_semantic_hash(spark, sf_dir):
    return op.semantic_hashes(_envelopes(spark, sf_dir), "pos", "payload", ["evaluator"])


def ru_equivalent(spark, sf_dir):
    return op.equivalence_classes(op.semantic_hashes(_envelopes(spark, sf_dir), "pos", "payload", ["evaluator"]), "pos")


def _layers(spark, sf_dir):
    p, n = F.col("pos"), F.length("text")
    fact = F.when(p % 11 == 3, _text('{"f1":"x","in":{"deep":[{"blame":1}]}}')).otherwise(_text('{"f1":"turn ', n, '","f2":', n, ',"f3":"', F.col("role"), '"}'))
    confidence = F.when(p % 7 == 1, '"high"').when(p % 7 == 2, '"0.25"').when(p % 7 == 3, "true").otherwise(_text(n % 10, ".5"))
    classification = F.when(p % 6 == 0, _text('{"routing":"r', n % 4, '"}')).when(p % 6 == 1, "[1]").otherwise(_text('{"routing":"r', n % 4, '","confidence":', confidence, "}"))
    said = F.when(p % 8 == 5, '"It IS Proven now",3').otherwise('"seen","\\"guilt\\": said",4')
    top = F.when(p % 31 == 7, '"ruling":1,').otherwise("")
    return _c(spark, sf_dir).select("pos", F.when(p % 37 == 9, "[not, json").otherwise(_text("{", top, '"fact_layer":', fact, ',"classification_layer":', classification, ',"interpretation_layer":{"statements":[', said, "]}}")).alias("payload"))


def ru_rejected(spark, sf_dir):
    return op.layered(_layers(spark, sf_dir), "pos", "payload", TOP, ANYWHERE, PHRASES).where("reason IS NOT NULL").select("pos", "reason")


def ru_statements(spark, sf_dir):
    found = op.layered(_layers(spark, sf_dir), "pos", "payload", TOP, ANYWHERE, PHRASES)
    return found.select("pos", F.explode("statements").alias("s")).select("pos", "s.kind", "s.content", "s.source", "s.confidence")


def ch_traces(spark, sf_dir):
    p, n = F.col("pos"), F.length("text")
    payload = F.when(p % 10 == 3, "null").when(p % 10 == 4, "[1]").when(p % 10 == 5, _text('{"reason":"r', n % 3, '","wu_id":', p, "}")).when(p % 10 == 6, '{"reason":5}').otherwise(_text('{"n":', n, ',"engine":"inner","scenario_id":"s', p % 4, '"}'))
    ts = F.when(p % 14 == 1, '"12"').when(p % 14 == 2, "1.5").otherwise((p * 1000).cast("string"))
    line = _text('{"ts_ns":', ts, ',"engine":"e', p % 3, '",', F.when(p % 15 == 8, "").otherwise(_text('"event":"', F.col("role"), '",')), '"payload":', payload, ',"prev_hash":"h', p, '","sig":"x"}')
    lines = _c(spark, sf_dir).select("pos", F.when(p % 41 == 6, "{broken").when(p % 43 == 6, "  ").otherwise(line).alias("line"))
    return op.strict_traces(lines, "pos", "line")


def ru_salvage(spark, sf_dir):
    """Objects in fences, amid prose, behind one that does not close, and nearly right ones."""
    p, n = F.col("pos"), F.length("text")
    json = _text('{"id":', p, ',"s":"a } \\" ] b","l":[', n % 5, ',{"k":"{"}]}')
    near = _text("{'id':", p, ",'l':[1,2,],}")
    fence = "```"
    text = (
        F.when(p % 6 == 0, _text("Here:\n" + fence + "json\n", json, "\n" + fence + "\nand {this"))
        .when(p % 6 == 1, _text("So it is ", json, " or [not"))
        .when(p % 6 == 2, _text(fence + "\nno json\n" + fence + "\nthen " + fence + "JSON\n", json, fence))
        .when(p % 6 == 3, _text("it says ", near, " at last"))
        .when(p % 6 == 4, json)
        .otherwise(_text("nothing { here \"", n))
    )
    return _c(spark, sf_dir).select("pos", op.salvaged(text).alias("found"))


QUERIES = {f.__name__: f for f in (ch_ingest_diff, ch_key_sets, ch_ingest_verdict, ru_semantic_hash, ru_equivalent, ru_rejected, ru_statements, ch_traces, ru_salvage)}

_C = "c AS (SELECT conv_id * 1000 + turn AS pos, role, length(text) AS n FROM conversations)"
_SIDES = f"""{_C}, l AS (
  SELECT pos, '{{"id":' || pos || ',"who":{{"role":"' || role || '","rank":' || pos % 7 || '}},"marks":[' || n % 5 || ',' || n % 11 || ',{{"deep":[' || n % 3 || ']}}],"size":' || n || ',"note":null}}' AS p FROM c WHERE pos % 23 <> 1
), r AS (
  SELECT pos, '{{"size":' || n || ',"marks":[' || n % 5 || ',' || n % 11 || ',{{"deep":[' || CASE WHEN pos % 17 = 3 THEN '9,"x"' ELSE (n % 3)::VARCHAR END || ']}}],"who":{{"rank":' || pos % 7 || ',"role":"' || CASE WHEN pos % 9 = 4 THEN 'editor' ELSE role END || '"}},"id":' || pos
    || CASE WHEN pos % 13 = 5 THEN ',"extra":{{"why":["late"]}}' ELSE '' END || CASE WHEN pos % 19 <> 2 THEN ',"note":null' ELSE '' END || '}}' AS p FROM c WHERE pos % 29 <> 1
)"""
_LEAVES = "SELECT pos, fullkey AS path, coalesce(atom::VARCHAR, 'null') AS v FROM {0}, json_tree({0}.p::JSON) WHERE atom IS NOT NULL OR type = 'NULL'"
_DIFF = f"""{_SIDES}, a AS ({_LEAVES.format("l")}), b AS ({_LEAVES.format("r")}),
d AS (SELECT pos, path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS left, b.v AS right FROM a FULL JOIN b USING (pos, path) WHERE a.v IS DISTINCT FROM b.v)"""
_HASHES = f"""{_C}, e AS (SELECT pos, n % 4 AS a, CASE WHEN pos % 5 = 0 THEN [n % 3, 7] ELSE [7, n % 3] END AS b, role FROM c),
h AS (SELECT pos, sha256('$.case.a=' || a || chr(10) || '$.case.b[0]=' || b[1] || chr(10) || '$.case.b[1]=' || b[2] || chr(10) || '$.role="' || role || '"') AS semantic_hash FROM e)"""
_LAYERS = f"""{_C}, x AS (SELECT *, CASE WHEN pos % 7 = 1 THEN NULL WHEN pos % 7 = 2 THEN 0.25e0 WHEN pos % 7 = 3 THEN 1e0 ELSE n % 10 + 0.5e0 END AS conf FROM c),
j AS (SELECT *, CASE WHEN pos % 37 = 9 THEN 'not an object' WHEN pos % 31 = 7 THEN 'forbidden at the top: ruling' WHEN pos % 11 = 3 THEN 'forbidden in facts: blame' WHEN pos % 6 > 1 AND conf IS NULL THEN 'confidence is no number' WHEN pos % 8 = 5 THEN 'forbidden language' END AS reason FROM x)"""

ORACLES = {
    "ch_ingest_diff": f"WITH {_DIFF} FROM d",
    "ch_key_sets": f"""WITH {_SIDES}, k AS (SELECT pos, coalesce(json_keys(l.p::JSON), []) AS a, coalesce(json_keys(r.p::JSON), []) AS b FROM l FULL JOIN r USING (pos)),
o AS (SELECT pos, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS x, list_sort(list_filter(b, lambda y: NOT list_contains(a, y))) AS y FROM k)
SELECT pos, array_to_string(x, ',') AS only_left, array_to_string(y, ',') AS only_right FROM o WHERE len(x) + len(y) > 0""",
    "ch_ingest_verdict": f"WITH {_DIFF} SELECT CASE WHEN count(*) > 0 THEN 'DIFF' ELSE 'MATCH' END AS verdict, count(DISTINCT pos) AS n_differing, (SELECT count(*) FROM r) - (SELECT count(*) FROM l) AS batch_delta, 0 AS verify_delta FROM d",
    "ru_semantic_hash": f"WITH {_HASHES} FROM h",
    "ru_equivalent": f"WITH {_HASHES} SELECT pos, min(pos) OVER (PARTITION BY semantic_hash) AS representative, count(*) OVER (PARTITION BY semantic_hash) AS class_size FROM h",
    "ru_rejected": f"WITH {_LAYERS} SELECT pos, reason FROM j WHERE reason IS NOT NULL",
    "ru_statements": f"""WITH {_LAYERS}, k AS (FROM j WHERE reason IS NULL)
SELECT pos, 'fact' AS kind, 'turn ' || n AS content, 'f1' AS source, NULL::DOUBLE AS confidence FROM k UNION ALL SELECT pos, 'fact', role, 'f3', NULL FROM k
UNION ALL SELECT pos, 'classification', 'r' || n % 4, NULL, CASE WHEN pos % 6 = 0 THEN 0.5e0 ELSE conf END FROM k WHERE pos % 6 <> 1
UNION ALL SELECT pos, 'interpretation', unnest(['seen', '"guilt": said']), NULL, NULL FROM k""",
    "ch_traces": f"""WITH {_C}, j AS (SELECT *, CASE WHEN pos % 41 = 6 THEN 'not JSON' WHEN pos % 14 IN (1, 2) THEN 'ts_ns must be an int' WHEN pos % 15 = 8 THEN 'event is missing' WHEN pos % 10 = 4 THEN 'payload must be an object' WHEN pos % 10 = 6 THEN 'payload.reason must be a string' END AS reason FROM c WHERE pos % 41 = 6 OR pos % 43 <> 6)
SELECT pos, reason, CASE WHEN reason IS NULL THEN CASE pos % 10 WHEN 3 THEN 'h' || pos WHEN 5 THEN pos::VARCHAR ELSE 's' || pos % 4 END END AS scenario_id, CASE WHEN reason IS NULL THEN pos * 1000 END AS timestamp_ns, CASE WHEN reason IS NULL THEN role END AS stage,
  CASE WHEN reason IS NULL AND pos % 10 = 5 THEN 'r' || n % 3 END AS fault_reason,
  CASE WHEN reason IS NULL THEN '{{"engine":"e' || pos % 3 || '",' || CASE WHEN pos % 10 IN (3, 5) THEN '' ELSE '"n":' || n || ',' END || '"prev_hash":"h' || pos || '",' || CASE WHEN pos % 10 = 5 THEN '"reason":"r' || n % 3 || '",' WHEN pos % 10 = 3 THEN '' ELSE '"scenario_id":"s' || pos % 4 || '",' END
    || '"sig":"x",' || CASE WHEN pos % 10 = 5 THEN '"wu_id":' || pos || ',' ELSE '' END || '"zarc_event":"' || role || '"}}' END AS metadata FROM j""",
    "ru_salvage": f"""WITH {_C} SELECT pos, CASE pos % 6 WHEN 3 THEN '{{"id":' || pos || ',"l":[1,2]}}' WHEN 5 THEN NULL ELSE '{{"id":' || pos || ',"s":"a }} \\" ] b","l":[' || n % 5 || ',{{"k":"{{"}}]}}' END AS found FROM c""",
}
