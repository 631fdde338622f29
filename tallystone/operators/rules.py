"""Rules and policies: a small condition language compiled to columns, verdicts, version and causality checks.

Conditions are nested dicts: {"all": [...]}, {"any": [...]}, {"not": ...} or {"field", "op", "value"}. A field that a
row lacks (null) makes the condition an error, which denies; ``condition`` gives the value and ``missing`` the error.
Types are strict where the rows' schema is given: values of different kinds (boolean, number, text, list) are unequal,
and to order them, to search in them or to match them is an error.
"""

from __future__ import annotations

import json
from functools import reduce
from hashlib import sha256
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructType

from tallystone.functions.canon import canonical
from tallystone.operators.chains import with_previous

OPS = {
    "eq": lambda a, b: a.eqNullSafe(b),
    "ne": lambda a, b: ~a.eqNullSafe(b),
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "in": lambda a, b: a.isin(b),
    "contains": lambda a, b: a.contains(b),
    "matches": lambda a, b: a.rlike(f"^(?:{b})$"),
}
VERDICTS = ["deny", "escalate", "allow"]


def _kind(value) -> str:
    """Kind of a literal: boolean, number, text or list."""
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "list"


def _column_kind(path: str, schema: StructType) -> str | None:
    """Kind of a field by its dotted path, null if the rows have no such field."""
    kind = schema
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return "boolean" if isinstance(kind, BooleanType) else "number" if isinstance(kind, NumericType) else "text" if isinstance(kind, StringType) else "list" if isinstance(kind, ArrayType) else "other"


def _parts(spec: dict) -> list[dict] | None:
    return spec.get("all", spec.get("any", [spec["not"]] if "not" in spec else None)) if "field" not in spec else None


def condition(spec: dict, schema: StructType | None = None) -> Column:
    """The condition's value; raises ValueError for what it does not know."""
    if len(spec) == 1 and "all" in spec:
        return reduce(and_, (condition(s, schema) for s in spec["all"]), F.lit(True))
    if len(spec) == 1 and "any" in spec:
        return reduce(or_, (condition(s, schema) for s in spec["any"]), F.lit(False))
    if len(spec) == 1 and "not" in spec:
        return ~condition(spec["not"], schema)
    if set(spec) != {"field", "op", "value"} or spec["op"] not in OPS:
        raise ValueError(f"not a condition: {spec}")
    op, value = spec["op"], spec["value"]
    if schema is not None:
        kind = _column_kind(spec["field"], schema)
        if kind is None or _mistyped(spec, schema):
            return F.lit(False)
        if op in ("eq", "ne") and kind != _kind(value):
            return F.lit(op == "ne")
        if op == "in":
            value = [v for v in value if _kind(v) == kind]
            if not value:
                return F.lit(False)
        if op == "contains" and kind == "list":
            return F.array_contains(spec["field"], value)
    return OPS[op](F.col(spec["field"]), value)


def _mistyped(spec: dict, schema: StructType) -> bool:
    """Whether an operator is asked of a kind of value that it doesn't take."""
    kind, wanted, op = _column_kind(spec["field"], schema), _kind(spec["value"]), spec["op"]
    if op in ("gt", "ge", "lt", "le"):
        return kind not in ("number", "text") or kind != wanted
    if op == "in":
        return wanted != "list"
    if op == "contains":
        return kind != "list" and not (kind == wanted == "text")
    return op == "matches" and not (kind == wanted == "text")


def missing(spec: dict, schema: StructType | None = None) -> Column:
    """Whether the condition is an error: a field that it reads is absent, or an operator doesn't take its kind of value."""
    parts = _parts(spec)
    if parts is not None:
        return reduce(or_, (missing(s, schema) for s in parts), F.lit(False))
    if schema is not None and (_column_kind(spec["field"], schema) is None or _mistyped(spec, schema)):
        return F.lit(True)
    return F.col(spec["field"]).isNull()


def rule_set(document: dict) -> tuple[str, list[dict], str]:
    """Version, rules (id, when, verdict, reason) and hash of a rule-set document; an error if anything in it is not as it must be.

    The hash is the SHA-256 of the document's canonical JSON, so it tells one policy from another whatever the order of names.
    """
    version, given = document.get("version"), document.get("rules")
    if not isinstance(version, str) or not version or not isinstance(given, list) or not given:
        raise ValueError("a rule set has a version and rules")
    rules = []
    for r in given:
        then = r.get("then") if isinstance(r, dict) else None
        if not isinstance(then, dict) or not isinstance(r.get("id"), str) or not r["id"] or "when" not in r or not isinstance(then.get("reason", ""), str):
            raise ValueError(f"not a rule: {r}")
        rules.append({"id": r["id"], "when": r["when"], "verdict": then.get("verdict"), "reason": then.get("reason", "")})
    check_rules(rules)
    return version, rules, sha256(canonical(json.dumps(document, default=str)).encode()).hexdigest()


def check_rules(rules: list[dict]) -> None:
    """Rules have id, when and verdict; ids are unique and verdicts known."""
    ids = [r["id"] for r in rules]
    if len({*ids}) != len(ids):
        raise ValueError("rule ids repeat")
    for r in rules:
        if r["verdict"] not in VERDICTS:
            raise ValueError(f"not a verdict: {r['verdict']}")
        condition(r["when"])


def verdicts(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows with verdict and reason: deny before escalate before allow, the first rule among equals; no match denies.

    The rules are columns of one projection, so a policy adds no join and no shuffle. Errors (an absent field, a value of
    another kind) deny.
    """
    check_rules(rules)
    fired = []
    for i, r in enumerate(rules):
        lacks = missing(r["when"], rows.schema)
        hit = F.when(lacks, F.struct(F.lit(0).alias("rank"), F.lit(i).alias("pos"), F.lit(f"{r['id']}:missing_field").alias("reason")))
        fired.append(hit.when(condition(r["when"], rows.schema), F.struct(F.lit(VERDICTS.index(r["verdict"])).alias("rank"), F.lit(i).alias("pos"), F.lit(r["id"]).alias("reason"))))
    best = F.array_min(F.array_compact(F.array(*fired)))
    names = F.array(*map(F.lit, VERDICTS))
    return rows.withColumn("_best", best).withColumn("verdict", F.coalesce(F.get(names, F.col("_best.rank")), F.lit("deny"))).withColumn("reason", F.coalesce("_best.reason", F.lit("no_match"))).drop("_best")


def keyword_matches(facts: DataFrame, rules: dict[str, list[str]], key: str) -> DataFrame:
    """(rule, key) of every fact that contains a trigger of a rule; rules are a short list."""
    hit = F.array_compact(F.array(*(F.when(reduce(or_, (F.lower("text").contains(t) for t in ts)), F.lit(r)) for r, ts in rules.items())))
    return facts.select(key, F.explode(hit).alias("rule"))


def node_confidence(matches: DataFrame, weights: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """For each rule min(its own confidence, mean weight of its facts) to four places, with a flag."""
    own = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    g = matches.join(weights, key).groupBy("rule").agg(F.avg("weight").alias("mean"), F.count(F.lit(1)).alias("facts"))
    value = F.bround(F.least(own[F.col("rule")], F.col("mean")), 4)
    return g.select("rule", "facts", value.alias("confidence"), F.when(value < 0.5, "low").otherwise("ok").alias("flag"))


def shared_fact_conflicts(matches: DataFrame, key: str) -> DataFrame:
    """For each rule the first other rule that a fact of its matches too, from the small sets of rules a fact has."""
    per_fact = matches.groupBy(key).agg(F.array_sort(F.collect_set("rule")).alias("rules")).where(F.size("rules") > 1).select("rules").distinct()
    a = per_fact.select(F.explode("rules").alias("rule"), "rules")
    return a.select("rule", F.explode(F.array_remove("rules", F.col("rule"))).alias("other")).groupBy("rule").agg(F.min("other").alias("conflicts_with"))


def collapsed(candidates: DataFrame, key: str, text: str, fallback: str) -> DataFrame:
    """The least normalised candidate of each key, the fallback where all are blank."""
    norm = F.nullif(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))
    return candidates.groupBy(key).agg(F.coalesce(F.min(norm), F.lit(fallback)).alias("text"), F.count_if(norm.isNull()).alias("dropped"))


def guarded(statements: Column) -> Column:
    """Statements that name a verdict are rejected, those that sound certain are downgraded."""
    return F.when(statements.rlike(r"(?i)\b(?:guilty|liable)\b"), "rejected").when(statements.rlike(r"(?i)\b(?:certainly|undoubtedly)\b"), "downgraded").otherwise("accepted")


def vector_merge(a: Column, b: Column) -> Column:
    """Element-wise maximum of two vector clocks."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def vector_order(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent. Only the clocks are compared."""
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    le, ge = F.forall(keys, lambda k: at(a, k) <= at(b, k)), F.forall(keys, lambda k: at(a, k) >= at(b, k))
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")


def monotonic_faults(rows: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Rows whose version is not above the one before, the first one's bound being 0; compared in stretches of ``order``."""
    found = with_previous(rows, key, order, version)
    return found.withColumn("before", F.coalesce(f"previous.{version}", F.lit(0))).drop("previous").where(F.col(version) <= F.col("before"))


def overlaps(agents: DataFrame) -> DataFrame:
    """Pairs of agents (agent, scopes) that share a scope, with what they share: joined by scope, not pair by pair."""
    s = agents.select("agent", F.explode(F.array_distinct("scopes")).alias("scope"))
    pairs = s.alias("x").join(s.alias("y"), "scope").where("x.agent < y.agent")
    return pairs.groupBy(F.col("x.agent").alias("a"), F.col("y.agent").alias("b")).agg(F.array_join(F.array_sort(F.collect_list("scope")), ",").alias("shared"))


def forks(decisions: DataFrame) -> DataFrame:
    """Dependencies on which more than one decision builds (decision, deps)."""
    return decisions.groupBy(F.array_join(F.array_sort("deps"), ",").alias("deps")).agg(F.count(F.lit(1)).alias("decisions"), F.min("decision").alias("first")).where("decisions > 1")


def quality_faults(rows: DataFrame, text: str, required: list[str], max_chars: int) -> DataFrame:
    """Rows with the checks that they fail: empty, length, forbidden wording, required words absent."""
    t = F.coalesce(F.col(text), F.lit(""))
    checks = [F.when(F.btrim(t) == "", "empty"), F.when(F.length(t) > max_chars, "too_long"), F.when(t.rlike(r"(?i)\b(?:guaranteed|promise)\b"), "forbidden")]
    checks += [F.when(~F.lower(t).contains(w), f"lacks_{w}") for w in required]
    return rows.withColumn("faults", F.array_join(F.array_compact(F.array(*checks)), ","))


def gate_outcome(attempts: DataFrame, key: str, order: str, budget: int = 2) -> DataFrame:
    """Outcome of a sequence of verdicts (ok): shipped at the first success within the budget, escalated at the next, else blocked."""
    first = F.min(F.when(F.col("ok"), F.col(order)))
    g = attempts.groupBy(key).agg(first.alias("first_ok"), F.count(F.lit(1)).alias("attempts"))
    return g.withColumn("outcome", F.when(F.col("first_ok") <= budget, "SHIP").when(F.col("first_ok") == budget + 1, "ESCALATED").otherwise("BLOCKED"))


def neighbours(edges: DataFrame, nodes: DataFrame, word: str) -> DataFrame:
    """Nodes (node, text) that contain a word, and those one edge (a, b) away."""
    hit = nodes.where(F.lower("text").contains(word)).select("node")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(hit, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
    return hit.withColumn("distance", F.lit(0)).unionByName(near.join(hit, "node", "left_anti").withColumn("distance", F.lit(1)))
