"""Checkpoints and composed outputs of governed operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """For each key the different elements of the arrays ``values``, in the order in which they first come.

    Elements are made distinct by an aggregate before they are listed, so a key with very many rows lists only its
    different elements.
    """
    each = rows.select(key, order, F.posexplode(values).alias("_p", "_v"))
    firsts = each.groupBy(key, "_v").agg(F.min(F.struct(order, "_p")).alias("_at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(values))


def composed(nodes: DataFrame, case: str, order: str) -> DataFrame:
    """Per case the evidence (premises) and the uncertainty flags ("; "-joined reasons) of its inference nodes, each once, in order."""
    flags = nodes.withColumn("flags", F.when(F.col("uncertainty") != "", F.split("uncertainty", "; ")))
    both = first_of_each(nodes, case, order, "premises").join(first_of_each(flags, case, order, "flags"), case, "full_outer")
    empty = F.array().cast("array<string>")
    return nodes.select(case).distinct().join(both, case, "left").select(case, F.coalesce("premises", empty).alias("evidence"), F.coalesce("flags", empty).alias("flags"))


def policy_route(level: Column) -> Column:
    """ALLOW for strict or allow (and where no level is given), QUARANTINE for quarantine or review, else FAIL."""
    mode = F.lower(F.coalesce(level, F.lit("strict")))
    return F.when(mode.isin("strict", "allow"), "ALLOW").when(mode.isin("quarantine", "review"), "QUARANTINE").otherwise("FAIL")


def compliance(projections: DataFrame, policies: DataFrame) -> DataFrame:
    """Projections (projection_id, bindings array, policy_id, depth, fields array) with violations and PASS or BLOCKED.

    ``policies`` has policy_id, max_depth and required (array), each null where the policy has no such rule.
    """
    rules = policies.select(F.col("policy_id").alias("_policy"), "max_depth", "required")
    rows = projections.join(rules, F.col("policy_id") == F.col("_policy"), "left")
    missing = F.transform(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.col("fields")), lambda f: F.concat(F.lit("required-field-missing:"), f))
    built_in = F.array(
        F.when(F.coalesce("projection_id", F.lit("")) == "", "no-unbound-projection"),
        F.when(F.coalesce(F.size("bindings"), F.lit(0)) <= 0, "no-empty-bindings"),
        F.when(F.coalesce("depth", F.lit(0)) > F.col("max_depth"), "max-depth-exceeded"),
    )
    out = rows.withColumn("violations", F.concat(F.array_compact(built_in), missing))
    return out.withColumn("status", F.when(F.size("violations") == 0, "PASS").otherwise("BLOCKED")).drop("_policy", "max_depth", "required")


def checkpoints(operations: DataFrame, ports: DataFrame, scopes: DataFrame, marker: str = "TERMINAL") -> DataFrame:
    """The first checkpoint that blocks each operation, null if it passes.

    Operations have op, required (array of ports), projection, path, scope, inputs (array), spec_hash and runtime_hash;
    ``ports`` the registered ports, ``scopes`` the allowed (projection, path, scope). In this order: M2 a required port
    is not registered, M1 the access is out of scope (only if there is one), M3 an input bears the terminal marker, M4
    the hashes of specification and runtime differ (only if both are known).
    """
    wanted = operations.select("op", F.explode(F.array_distinct("required")).alias("port"))
    unregistered = wanted.join(ports.select("port").distinct(), "port", "left_anti").select("op").distinct().withColumn("_m2", F.lit(True))
    allowed = scopes.select("projection", "path", "scope").distinct().withColumn("_in", F.lit(True))
    rows = operations.join(unregistered, "op", "left").join(allowed, ["projection", "path", "scope"], "left")
    reenters = F.exists(F.coalesce("inputs", F.array().cast("array<string>")), lambda x: x.contains(marker))
    blocked = (
        F.when(F.col("_m2"), "M2")
        .when(F.col("projection").isNotNull() & F.col("_in").isNull(), "M1")
        .when(reenters, "M3")
        .when(F.col("spec_hash") != F.col("runtime_hash"), "M4")
    )
    return rows.withColumn("blocked", blocked).drop("_m2", "_in")


def audit_counts(checked: DataFrame) -> DataFrame:
    """One row of counts over checked operations: all, blocked at each checkpoint, audited and diverged."""
    audited = F.col("spec_hash").isNotNull() & F.col("runtime_hash").isNotNull() & F.coalesce(F.col("blocked"), F.lit("M4")).isin("M4")
    blocked = [F.count_if(F.col("blocked") == m).alias(f"blocked_{m.lower()}") for m in ("M1", "M2", "M3")]
    return checked.agg(F.count(F.lit(1)).alias("operations"), *blocked, F.count_if(audited).alias("audited"), F.count_if(F.col("blocked") == "M4").alias("diverged"))
