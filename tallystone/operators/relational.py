"""Statement shapes of a ledger store: look-ups, newest rows, ranges, upserts, deletes, constraints and version audits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(table: DataFrame, **given) -> DataFrame:
    """Rows that meet every given equality; arguments that are None do not restrict. All reach the scan."""
    return table.where(reduce(and_, (F.col(c) == v for c, v in given.items() if v is not None), F.lit(True)))


def newest(table: DataFrame, n: int, *order: str, **given) -> DataFrame:
    """The n rows that come last in ``order``, of those that meet the given equalities."""
    return where_all(table, **given).orderBy(*(F.desc(c) for c in order)).limit(n)


def equal_or_contains(table: DataFrame, column: str, exact: str, part: str) -> DataFrame:
    return table.where((F.col(column) == exact) | F.col(column).contains(part))


def latest_per_key(table: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the last in ``order``: an aggregate that combines before the shuffle, not a sort of each key."""
    others = [c for c in table.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return table.groupBy(key).agg(best.alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in others))


def key_range(table: DataFrame, column: str, low, high, limit: int = 1000) -> DataFrame:
    return table.where(F.col(column).between(low, high)).orderBy(column).limit(limit)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks (insert, on conflict do nothing)."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """``table`` with ``rows`` written over it: of each key the row of largest version stays, the new one among equals."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest_per_key(both, key, version, "_new").drop("_new")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys in ``gone``."""
    keys = gone.select(F.col(key).alias("_gone"))
    return parents.join(keys, F.col(key) == F.col("_gone"), "left_anti"), children.join(keys, F.col(child_key) == F.col("_gone"), "left_anti")


def violations(table: DataFrame, name: str, key: str, *, allowed: dict[str, list] | None = None, refers: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """Constraint audit: rule, number of rows at fault. Checks enumerations, uniqueness of ``key`` and a foreign key."""
    rule = lambda text, df: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(f"{name}.{text}").alias("rule"), "n_rows")
    out = rule(f"{key}.unique", table.groupBy(key).count().where("count > 1"))
    for column, values in (allowed or {}).items():
        out = out.unionByName(rule(f"{column}.allowed", table.where(~F.col(column).isin(values))))
    if refers:
        column, other, other_key = refers
        orphans = table.where(F.col(column).isNotNull()).join(other.select(F.col(other_key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
        out = out.unionByName(rule(f"{column}.refers", orphans))
    return out


def active_keys(users: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Users with their keys that are active and not expired (user_id, active, expires_at null for never)."""
    live = keys.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))))
    return users.join(live, "user_id")


def has_role(roles: Column, role: str) -> Column:
    """Whether a JSON array of strings holds the role as a whole element."""
    return F.array_contains(F.from_json(roles, "array<string>"), role)


def next_version(cases: DataFrame, table: DataFrame, key: str, version: str) -> DataFrame:
    """For each case the least next version that the table holds for it, 1 where it holds none."""
    first = table.groupBy(key).agg(F.min(version).alias("_first"))
    return cases.select(key).distinct().join(first, key, "left").select(key, F.coalesce("_first", F.lit(1)).alias("next_version"))


def version_gaps(table: DataFrame, key: str, version: str) -> DataFrame:
    """Keys whose versions do not run 1, 2, 3, ... : with one aggregate, n distinct versions from 1 to n."""
    seen = table.groupBy(key).agg(F.count_distinct(version).alias("n_versions"), F.min(version).alias("first"), F.max(version).alias("last"), F.count(F.lit(1)).alias("n_rows"))
    return seen.where((F.col("first") != 1) | (F.col("last") != F.col("n_versions")) | (F.col("n_rows") != F.col("n_versions")))


def verified_latest(table: DataFrame, key: str, expected: DataFrame, *order: str) -> DataFrame:
    """The latest row of each key with whether its hash is the expected one (key, expected_hash)."""
    return latest_per_key(table, key, *order).join(expected, key, "left").withColumn("verified", F.col("hash").eqNullSafe(F.col("expected_hash")))
