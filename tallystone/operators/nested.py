"""Nested JSON as rows: differences, order-free hashes, typed layers, strict traces and objects salvaged from prose.

Texts are parsed as VARIANT and taken apart level by level, so nothing leaves the JVM. A level is one round; lineage is
cut after it. Paths look like ``$.a."odd key"[2]``. Numbers are compared as VARIANT writes them (1.0 is 1). What is no
JSON counts as a missing value. Ids are to be different for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.lineage import cut

_PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"
#: Strings of a JSON text from left to right, with the colon behind a key.
_STRINGS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (JSON's null), or null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _first_closed(text: Column, finish) -> Column:
    """``finish`` of what folding over the brackets of a text from its beginning gives: done, and the length up to the bracket that closes the first."""
    tokens = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[{]|[\]}]|[^"\[\]{}]++|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))
    opens, closes = (lambda t: t.isin("{", "[")), (lambda t: t.isin("}", "]"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + opens(t).cast("int") - closes(t).cast("int")
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["length"] + F.length(t)).alias("length"), (closes(t) & (depth == 0)).alias("done")))

    return F.aggregate(tokens, start, step, finish)


def _balanced(text: Column) -> Column:
    """The first object or list of a text, from its opening bracket to the one that closes it outside of strings; null if none closes."""
    at = F.regexp_instr(text, F.lit(r"[\[{]"))
    rest = F.substring(text, at, F.length(text))
    return F.when(at > 0, F.substring(rest, F.lit(1), _first_closed(rest, lambda end: F.when(end["done"], end["length"]))))


def parsed(text: Column) -> Column:
    """The VARIANT of a text that is JSON from end to end, else null (the parser by itself passes over what follows a value)."""
    core = F.regexp_replace(text, r"^\s+|\s+$", "")
    scalar = core.rlike(r'^(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|true|false|null|-?[0-9][0-9.eE+-]*)$')
    closed = _first_closed(core, lambda end: end["done"] & (end["length"] == F.length(core)))
    return F.when(F.when(core.rlike(r"^[\[{]"), closed).otherwise(scalar), F.try_parse_json(core))


def leaves(rows: DataFrame, key: str, text: str, drop: Sequence[str] = ()) -> DataFrame:
    """key, path and value (as JSON) of every scalar and empty container of the texts; without ``drop``, names at the top.

    A null text, or one that is no JSON, has no rows.
    """
    # Stored, so that a text is parsed once.
    front = cut(rows.select(F.col(key).alias("_id"), F.lit("$").alias("path"), parsed(F.col(text)).alias("v"))).where("v IS NOT NULL")
    out, top = None, True
    while True:
        empty = F.to_json("v").isin("{}", "[]")
        inner = kind_of(F.col("v")).isin("OBJECT", "ARRAY") & ~empty
        found = front.where(~inner).select(F.col("_id").alias(key), "path", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))
        out = found if out is None else out.unionByName(found)
        deeper = front.sparkSession.sql("SELECT _id, path, e.pos, e.key, e.value AS v FROM {f}, LATERAL variant_explode(v) AS e", f=front.where(inner))
        quoted = F.concat(F.lit('"'), F.regexp_replace("key", r'(["\\])', r"\\$1"), F.lit('"'))
        name = F.when(F.col("key").rlike(_PLAIN_KEY), F.col("key")).otherwise(quoted)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), name))
        if top and drop:
            deeper = deeper.where(F.col("key").isNull() | ~F.col("key").isin(*drop))
        front, top = cut(deeper.select("_id", F.concat("path", step).alias("path"), "v")), False
        if front.isEmpty():
            return out


def ingest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """pos, path, change (added, removed, changed), left and right of the values in which two ingests (pos, payload) differ.

    A position that one of them lacks gives all its values as added or removed.
    """
    a, b = (leaves(x, "pos", "payload").withColumnRenamed("value", n) for x, n in ((left, "left"), (right, "right")))
    both = a.join(b, ["pos", "path"], "full_outer")
    change = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").when(F.col("left") != F.col("right"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("pos", "path", "change", "left", "right")


def key_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """pos with the names at the top of either payload that the other lacks, in order; only where there are any."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    both = left.select("pos", keys("payload").alias("a")).join(right.select("pos", keys("payload").alias("b")), "pos", "full_outer")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    out = both.select("pos", F.array_sort(F.array_except(a, b)).alias("only_left"), F.array_sort(F.array_except(b, a)).alias("only_right"))
    return out.where((F.size("only_left") > 0) | (F.size("only_right") > 0))


def ingest_verdict(diff: DataFrame, runs: DataFrame) -> DataFrame:
    """One row on two ingests: verdict, n_differing positions, batch_delta and verify_delta.

    ``runs`` has side ("left", "right"), ingested and verified, null if not known. A chain that failed to verify fails the
    comparison, an unknown number leaves it incomplete, else any difference is one.
    """
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    r = runs.agg(*(of(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("ingested", "verified")))
    n = diff.agg(F.count_distinct("pos").alias("n_differing"))
    failed = ~F.coalesce("left_verified", F.lit(True)) | ~F.coalesce("right_verified", F.lit(True))
    unknown = F.col("left_ingested").isNull() | F.col("right_ingested").isNull()
    verdict = F.when(failed, "FAIL_CHAIN_VERIFICATION").when(unknown, "INCOMPLETE").when(F.col("n_differing") > 0, "DIFF").otherwise("MATCH")
    # One row against one row.
    return r.join(F.broadcast(n)).select(
        verdict.alias("verdict"), "n_differing", (F.col("right_ingested") - F.col("left_ingested")).alias("batch_delta"), (F.col("right_verified").cast("int") - F.col("left_verified").cast("int")).alias("verify_delta")
    )


def semantic_hashes(rows: DataFrame, key: str, text: str, drop: Sequence[str] = ()) -> DataFrame:
    """key and semantic_hash of each JSON text: equal for texts of equal values, whatever the order of names in objects.

    Lists keep their order. ``drop`` names what is not observable, at the top. A text that is no JSON has a null hash.
    """
    lines = leaves(rows, key, text, drop).select(key, F.concat("path", F.lit("="), "value").alias("_l"))
    # As many lines as the record has values.
    digests = lines.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_l")), "\n"), 256).alias("semantic_hash"))
    # A record all of whose names are dropped equals an empty one.
    return rows.select(key, parsed(F.col(text)).isNotNull().alias("_p")).join(digests, key, "left").select(key, F.coalesce("semantic_hash", F.when(F.col("_p"), F.sha2(F.lit("$={}"), 256))).alias("semantic_hash"))


def equivalence_classes(hashes: DataFrame, key: str) -> DataFrame:
    """key, representative (the least of its class) and class_size; rows without a hash are alone."""
    known = hashes.where("semantic_hash IS NOT NULL")
    classes = known.groupBy("semantic_hash").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("class_size"))
    joined = hashes.join(classes, "semantic_hash", "left")
    return joined.select(key, F.coalesce("representative", F.col(key)).alias("representative"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keys_at_any_depth(text: Column) -> Column:
    """All names of a JSON text in the order in which they stand, repeats included."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_STRINGS), F.lit(0)), lambda t: t.endswith(":"))
    return F.transform(tokens, lambda t: F.from_json(F.concat(F.lit("["), F.regexp_replace(t, r"\s*:$", ""), F.lit("]")), "array<string>")[0])


def layered(rows: DataFrame, key: str, text: str, forbidden_top: Sequence[str], forbidden: Sequence[str], phrases: Sequence[str]) -> DataFrame:
    """key, reason (null if the text passes) and statements of JSON texts with fact, classification and interpretation layers.

    A text is rejected for a name of ``forbidden_top`` at the top, for one of ``forbidden`` at any depth of a layer, for
    a confidence that is no number, or for an interpretation that holds one of ``phrases`` in any case; what comes first
    in that order of layers is the reason. Statements (kind, content, source, confidence) are facts that are strings, the
    routing, "" if there is none, and interpretations that are strings; layers of other kinds are passed over.
    """
    layer = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}_layer", "variant")
    get = lambda c, path, kind: F.try_variant_get(F.col(c), path, kind)
    is_object = lambda c: kind_of(F.col(c)) == "OBJECT"
    first = lambda keys, among: F.get(F.filter(keys, lambda k: k.isin(*among)), F.lit(0)) if among else F.lit(None).cast("string")
    parts = rows.select(key, parsed(F.col(text)).alias("_v"), F.json_object_keys(text).alias("_top")).select(key, "_v", "_top", layer("fact").alias("_f"), layer("classification").alias("_c"), layer("interpretation").alias("_i"))
    bad = lambda c: F.when(is_object(c), first(keys_at_any_depth(F.to_json(c)), forbidden))
    given = get("_c", "$.confidence", "variant")
    number = F.when(kind_of(given).isin("OBJECT", "ARRAY", "VOID"), None).otherwise(F.coalesce(given.try_cast("double"), F.when(given.try_cast("string") == "true", 1.0).when(given.try_cast("string") == "false", 0.0)))
    routing = F.when(is_object("_c"), F.when(get("_c", "$.routing", "variant").isNull(), F.lit("")).when(kind_of(get("_c", "$.routing", "variant")) == "STRING", get("_c", "$.routing", "string")))
    routing = F.when(F.col("_c").isNull(), F.lit("")).otherwise(routing)
    said = F.when(is_object("_i") & (kind_of(get("_i", "$.statements", "variant")) == "ARRAY"), F.try_variant_get("_i", "$.statements", "array<variant>"))
    texts = F.transform(F.filter(said, lambda x: kind_of(x) == "STRING"), lambda x: x.cast("string"))
    none = F.array().cast("array<string>")
    facts = F.when(is_object("_f"), F.map_entries(F.col("_f").cast("map<string,variant>")))
    facts = F.filter(facts, lambda e: kind_of(e["value"]) == "STRING")
    parts = parts.select("*", number.alias("_n"), given.isNotNull().alias("_given"), routing.alias("_r"), F.coalesce(texts, none).alias("_s"), facts.alias("_facts"))
    spoken = F.exists("_s", lambda s: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(s), p))) if phrases else F.lit(False)
    name = lambda where, key_: F.when(key_.isNotNull(), F.concat(F.lit(f"forbidden {where}: "), key_))
    reason = F.coalesce(
        F.when(F.col("_v").isNull() | ~is_object("_v"), "not an object"),
        name("at the top", first(F.col("_top"), forbidden_top)),
        name("in facts", bad("_f")),
        name("in classification", bad("_c")),
        F.when(F.col("_r").isNotNull() & F.col("_given") & F.col("_n").isNull(), "confidence is no number"),
        name("in interpretation", bad("_i")),
        F.when(spoken, "forbidden language"),
    )
    made = lambda kind, content, source=None, confidence=None: F.struct(
        F.lit(kind).alias("kind"), content.alias("content"), (F.lit(None).cast("string") if source is None else source).alias("source"), (F.lit(None).cast("double") if confidence is None else confidence).alias("confidence")
    )
    empty = F.array().cast("array<struct<kind:string,content:string,source:string,confidence:double>>")
    statements = F.concat(
        F.coalesce(F.transform("_facts", lambda e: made("fact", e["value"].cast("string"), e["key"])), empty),
        F.when(F.col("_r").isNotNull(), F.array(made("classification", F.col("_r"), None, F.coalesce("_n", F.lit(0.5))))).otherwise(empty),
        F.transform("_s", lambda s: made("interpretation", s)),
    )
    return parts.select(key, reason.alias("reason"), statements.alias("_all")).select(key, "reason", F.when(F.col("reason").isNull(), F.col("_all")).alias("statements"))


def strict_traces(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, reason (null for a good line), scenario_id, timestamp_ns, stage, fault_reason and metadata of chain lines.

    A good line is a JSON object of ts_ns (a whole number), event, engine, prev_hash and sig (strings) and a payload that
    is an object, null or absent, whose ``reason``, if any, is a string. The first thing that is wrong is the reason, in
    that order; a rejected line keeps key and reason alone. metadata is the payload with engine, prev_hash, sig and
    zarc_event put in, names in order. Blank lines are left out.
    """
    p, get = F.col("_p"), lambda path, kind="variant": F.try_variant_get(F.col("_v"), path, kind)
    rows = lines.where(F.trim(F.col(line)) != "").select(key, parsed(F.col(line)).alias("_v")).withColumn("_p", get("$.payload"))
    a_string = lambda name: F.when(get(f"$.{name}").isNull(), f"{name} is missing").when(kind_of(get(f"$.{name}")) != "STRING", f"{name} must be a string")
    payload = F.when(p.isNull() | (kind_of(p) == "VOID"), F.parse_json(F.lit("{}"))).when(kind_of(p) == "OBJECT", p)
    reason_of = F.try_variant_get(p, "$.reason", "variant")
    reason = F.coalesce(
        F.when(F.col("_v").isNull(), "not JSON").when(kind_of(F.col("_v")) != "OBJECT", "not an object"),
        F.when(get("$.ts_ns").isNull(), "ts_ns is missing").when(kind_of(get("$.ts_ns")) != "BIGINT", "ts_ns must be an int"),
        a_string("event"),
        F.when(payload.isNull(), "payload must be an object"),
        a_string("engine"),
        a_string("prev_hash"),
        a_string("sig"),
        F.when(~kind_of(reason_of).isin("STRING", "VOID"), "payload.reason must be a string"),
    )
    ok = F.col("reason").isNull()
    judged = rows.select(key, "_v", payload.alias("_p"), reason.alias("reason"))
    fields = F.map_filter(F.col("_p").cast("map<string,variant>"), lambda k, _: ~k.isin("engine", "prev_hash", "sig", "zarc_event"))
    added = F.map_from_arrays(F.array(*map(F.lit, ("engine", "prev_hash", "sig", "zarc_event"))), F.array(*(get(f"$.{n}") for n in ("engine", "prev_hash", "sig", "event"))))
    metadata = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(fields, added)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))
    named = lambda name: F.try_variant_get("_p", f"$.{name}", "variant")
    shown = lambda v: F.when(kind_of(v) == "VOID", "None").when(kind_of(v) == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(v.cast("string"))
    scenario = F.when(named("wu_id").isNotNull(), shown(named("wu_id"))).when(named("scenario_id").isNotNull(), shown(named("scenario_id"))).otherwise(get("$.prev_hash", "string"))
    return judged.select(
        key,
        "reason",
        F.when(ok, scenario).alias("scenario_id"),
        F.when(ok, get("$.ts_ns", "long")).alias("timestamp_ns"),
        F.when(ok, get("$.event", "string")).alias("stage"),
        F.when(ok, F.try_variant_get("_p", "$.reason", "string")).alias("fault_reason"),
        F.when(ok, metadata).alias("metadata"),
    )


def salvaged(text: Column, repair: bool = True) -> Column:
    """The JSON object or list that a text holds amid prose, as it stands there; null if there is none.

    Candidates are the fenced blocks in order, the whole text, then the first brackets that close (those within strings
    do not count); the first that parses is taken. With ``repair``, failing that, the stretch from the first brace to
    the last is tried with single quotes made double and commas before a closing bracket taken out.
    """
    container = lambda c: kind_of(parsed(c)).isin("OBJECT", "ARRAY")
    fenced = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:[Jj][Ss][Oo][Nn])?\s*(.*?)\s*```"), F.lit(1)), lambda x: F.btrim(x))
    candidates = F.concat(fenced, F.array(F.trim(text)), F.array_compact(F.array(_balanced(text))))
    found = F.get(F.filter(candidates, container), F.lit(0))
    if not repair:
        return found
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(F.regexp_replace(braced, r"'([^'\\]*)'", '"$1"'), r",(\s*[}\]])", "$1")
    return F.coalesce(found, F.when(kind_of(parsed(mended)) == "OBJECT", mended))
