"""Registers read from chains and logs: report versions, manifests, cell results, planes of entities, counts and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.scalars import stable_id
from tallystone.operators.entities import device_form, email_form, entity_id, organisation_form, person_form, software_form


def report_versions(chain: DataFrame, case_id: str | None = None) -> DataFrame:
    """The reports that a chain (seq, engine, event, ts_ns, payload struct) has recorded, of one case or of all."""
    p = lambda f: F.coalesce(F.col(f"payload.{f}"), F.lit("")).alias(f)
    rows = chain.where("engine = 'rfe' AND event = 'report_generated'")
    if case_id is not None:
        rows = rows.where(F.col("payload.case_id") == case_id)
    return rows.select("seq", p("version_id"), p("case_id"), p("report_hash"), F.col("ts_ns").alias("timestamp_ns"), "event")


def manifests_by_fingerprint(chain: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted fingerprint the first report with it that has a manifest."""
    rows = chain.where("engine = 'rfe' AND event = 'report_generated' AND payload.manifest IS NOT NULL")
    found = rows.select("seq", F.col("payload.manifest_fingerprint").alias("fingerprint"), F.col("payload.manifest").alias("manifest")).join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return found.groupBy("fingerprint").agg(F.min("seq").alias("seq"), F.min_by("manifest", "seq").alias("manifest"))


def cell_streams(results: DataFrame, polarity: dict[str, str], stream_type: str = "cell_output") -> DataFrame:
    """Results of cells (cell_id, taxonomy, verdict, final_output, tier, confidence, provenance_hash, ts) as evidence streams.

    ``polarity`` maps verdicts to claims, the others are neutral; a stream's id follows from its cell and provenance.
    """
    claim = F.coalesce(F.create_map(*(F.lit(x) for kv in sorted(polarity.items()) for x in kv))[F.col("verdict")], F.lit("neutral"))
    tags = F.filter(F.split("taxonomy", "/"), lambda t: t != "")
    return results.withColumn("claim", claim).select(
        F.concat_ws("_", "cell_id", stable_id(F.col("cell_id"), F.col("provenance_hash"), length=12)).alias("stream_id"),
        F.lit(stream_type).alias("type"),
        F.col("tier").alias("source_tier"),
        "claim",
        F.col("taxonomy").alias("subject"),
        F.col("final_output").alias("text"),
        "confidence",
        "provenance_hash",
        F.col("ts").alias("timestamp"),
        F.when(F.col("claim") == "negative", 0.6).otherwise(0.5).alias("severity_impact"),
        tags.alias("relevance_tags"),
    )


def plane_entities(artifacts: DataFrame) -> DataFrame:
    """Entities of the container, application and content planes of artifacts, one row a mention.

    Columns: artifact, container (from_addr, to_addrs, cc_addrs, bcc_addrs), app (author, producer, creator, company,
    last_modified_by, manager, template) and content (email_addresses, ip_addresses, mac_addresses, phone_numbers).
    The server of a template's network path is a device. Values that are empty or have no normal form give no entity.
    """

    def mentions(values: Column, kind: str, field: str, form) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), form(v).alias("form"), v.alias("display"), F.lit(field).alias("field")))

    one = lambda path: F.array(F.col(path))
    none = F.array().cast("array<string>")
    addresses = F.concat(one("container.from_addr"), *(F.coalesce(F.col(f"container.{c}"), none) for c in ("to_addrs", "cc_addrs", "bcc_addrs")))
    same = lambda v: v
    template = lambda v: F.lower(F.nullif(F.regexp_extract(v, r"\\\\([^\\]+)", 1), F.lit("")))
    found = F.concat(
        mentions(addresses, "email", "container.from_addr", email_form),
        mentions(one("app.author"), "person", "app.author", person_form),
        mentions(one("app.producer"), "software", "app.producer", software_form),
        mentions(one("app.creator"), "software", "app.creator", software_form),
        mentions(one("app.company"), "organization", "app.company", organisation_form),
        mentions(one("app.last_modified_by"), "person", "app.last_modified_by", person_form),
        mentions(one("app.manager"), "person", "app.manager", person_form),
        mentions(one("app.template"), "device", "app.template_server", template),
        mentions(F.col("content.email_addresses"), "email", "content.email_addresses", email_form),
        mentions(F.col("content.ip_addresses"), "device", "content.ip_addresses", F.lower),
        mentions(F.col("content.mac_addresses"), "device", "content.mac_addresses", device_form),
        mentions(F.col("content.phone_numbers"), "device", "content.phone_numbers", same),
    )
    rows = artifacts.select("artifact", F.explode(found).alias("m")).select("artifact", "m.*").where("display <> '' AND form IS NOT NULL AND form <> ''")
    return rows.withColumn("entity_id", entity_id(F.col("kind"), F.col("form")))


def pressure_trend(epochs: DataFrame, key: str, order: str, total_tu: float, max_backlog: float, low: float = 0.7, idle: float = 0.05, high: float = 0.9, backlog: float = 0.2) -> DataFrame:
    """For each key its epochs (tu_allocated, submitted), the means of utilisation and backlog and the last recommendation:
    -1 if idle with some backlog, +1 if overloaded, else 0."""
    util = F.col("tu_allocated") / F.lit(float(total_tu)) if total_tu > 0 else F.lit(0.0)
    ratio = F.col("submitted") / F.lit(float(max_backlog)) if max_backlog > 0 else F.lit(0.0)
    rec = F.when((util < low) & (ratio > idle), -1).when((util > high) | (ratio > backlog), 1).otherwise(0)
    return epochs.groupBy(key).agg(F.count(F.lit(1)).alias("epochs"), F.avg(util).alias("avg_util"), F.avg(ratio).alias("avg_backlog"), F.max_by(rec, order).alias("recommendation"))


def registry_health(models: DataFrame) -> DataFrame:
    """One row: models in all, running and in error, and whether the registry is healthy (none in error)."""
    out = models.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "ERROR").alias("error"))
    return out.withColumn("status", F.when(F.col("error") == 0, "HEALTHY").otherwise("DEGRADED"))


def bucket_members(runs: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """For each bucket of runs (run_id, bucket) and each name among their parts (run_id, name): parts and runs that have it."""
    return parts.join(runs.select("run_id", "bucket"), "run_id").groupBy("bucket", name).agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("run_id").alias("runs"))


def with_findings(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Artifacts (artifact) with the findings (finding, kind, affected: array of artifacts) that name them, in order.

    A finding that names an artifact twice counts once; artifacts without findings have an empty list.
    """
    named = findings.select(F.explode(F.array_distinct("affected")).alias("artifact"), "finding", "kind")
    lists = named.groupBy("artifact").agg(F.array_sort(F.collect_set(F.struct("finding", "kind"))).alias("findings"))
    return artifacts.join(lists, "artifact", "left").withColumn("findings", F.coalesce("findings", F.array().cast(lists.schema["findings"].dataType)))


def policy_report(runs: DataFrame, families: dict[str, str], default: str = "other") -> DataFrame:
    """Per policy and origin (policy, synthetic, blocked, violations array) runs, blocked ones, their rate, and violations by family."""
    names = sorted({*families.values(), default})
    mapping = F.create_map(*(F.lit(x) for kv in sorted(families.items()) for x in kv))
    kinds = F.transform(F.coalesce("violations", F.array().cast("array<string>")), lambda v: F.coalesce(mapping[v], F.lit(default)))
    count = lambda name: F.sum(F.size(F.filter(kinds, lambda k: k == name))).alias(f"n_{name}")
    return runs.groupBy("policy", "synthetic").agg(F.count(F.lit(1)).alias("runs"), F.count_if("blocked").alias("blocked"), F.avg(F.col("blocked").cast("int")).alias("rate"), *map(count, names))
