"""Ledger-store queries over orders, customers, events and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import relational as op
from tallystone.session import table


def rl_lookup(spark, sf_dir):
    return op.where_all(table(spark, sf_dir, "customer"), c_custkey=7)


def rl_ordered_fetch(spark, sf_dir):
    return op.where_all(table(spark, sf_dir, "events"), user_id=3).orderBy("event_id").select("event_id", "ts", "event_type")


def rl_topn(spark, sf_dir):
    return op.newest(table(spark, sf_dir, "events"), 20, "ts", "event_id", event_type="error", user_id=None).select("event_id", "user_id")


def rl_like_or(spark, sf_dir):
    return op.equal_or_contains(table(spark, sf_dir, "part"), "p_name", "red widget", "bolt").select("p_partkey", "p_name")


def rl_latest_per_key(spark, sf_dir):
    return op.latest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


def rl_height(spark, sf_dir):
    """Every customer's latest order as its height, -1 for those without."""
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("height"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(top, c["c_custkey"] == top["o_custkey"], "left").select("c_custkey", F.coalesce("height", F.lit(-1).cast("long")).alias("height"))


def rl_range(spark, sf_dir):
    return op.key_range(table(spark, sf_dir, "orders"), "o_orderkey", 100, 5000).select("o_orderkey", "o_custkey")


def _old_and_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_totalprice")
    parts = [op.latest_per_key(o.where(c), "k", "v") for c in ("v % 2 = 0", "v % 2 = 1")]
    return parts[0].where("k % 3 <> 0"), parts[1].where("k % 3 <> 1")


def rl_upsert(spark, sf_dir):
    return op.upsert(*_old_and_new(spark, sf_dir), "k", "v")


def rl_anti_insert(spark, sf_dir):
    return op.insert_new(*_old_and_new(spark, sf_dir), "k")


def rl_delete_cascade(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parents, children = op.delete_cascade(c, o, c.where("c_acctbal < 0"), "c_custkey", "o_custkey")
    return parents.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("parent")).unionByName(children.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("child")))


def rl_constraints(spark, sf_dir):
    return op.violations(
        table(spark, sf_dir, "orders"), "orders", "o_orderkey", allowed={"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, refers=("o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey")
    )


def rl_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    keys = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("key_id"), (F.col("o_orderstatus") == "O").alias("active"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("expires_at")
    )
    return op.active_keys(users, keys, "1999-01-01 00:00:00").select("user_id", "c_name", "key_id")


def rl_roles(spark, sf_dir):
    """Users with the role 'admin' in a JSON array; a role that only contains the word is not it."""
    roles = F.when(F.col("c_custkey") % 3 == 0, '["admin","audit"]').when(F.col("c_custkey") % 3 == 1, '["superadmin"]').otherwise("[]")
    return table(spark, sf_dir, "customer").where(op.has_role(roles, "admin")).select("c_custkey")


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("case_id"), F.when(F.col("user_id") % 2 == 0, F.col("event_id") % 5 + 1).otherwise(F.col("event_id") % 7 * 2).alias("version"))


def rl_version_gap(spark, sf_dir):
    return op.version_gaps(_versions(spark, sf_dir).distinct(), "case_id", "version").select("case_id", "n_versions", "first", "last")


def rl_next_version(spark, sf_dir):
    v = _versions(spark, sf_dir)
    held = v.where("case_id % 9 <> 0").select("case_id", (F.col("version") + 1).alias("next_version"))
    return op.next_version(v, held, "case_id", "next_version")


def rl_verified(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))
    expected = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.sha2(F.max("o_orderkey").cast("string"), 256).alias("expected_hash"))
    return op.verified_latest(o, "k", expected, "o_orderkey").select("k", "verified")


_PARTS = """WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice FROM orders),
a AS (SELECT * FROM o WHERE v % 2 = 0 AND k % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1),
b AS (SELECT * FROM o WHERE v % 2 = 1 AND k % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1)"""
_CASES = "WITH c AS (SELECT user_id AS case_id, CASE WHEN user_id % 2 = 0 THEN event_id % 5 + 1 ELSE event_id % 7 * 2 END AS version FROM events)"

QUERIES = {f.__name__: f for f in (
    rl_lookup, rl_ordered_fetch, rl_topn, rl_like_or, rl_latest_per_key, rl_height, rl_range, rl_upsert, rl_anti_insert, rl_delete_cascade, rl_constraints, rl_join, rl_roles, rl_version_gap, rl_next_version, rl_verified,
)}

ORACLES = {
    "rl_lookup": "SELECT * FROM customer WHERE c_custkey = 7",
    "rl_ordered_fetch": "SELECT event_id, ts, event_type FROM events WHERE user_id = 3 ORDER BY event_id",
    "rl_topn": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "rl_like_or": "SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget' OR p_name LIKE '%bolt%'",
    "rl_latest_per_key": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "rl_height": "SELECT c_custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), -1) AS height FROM customer",
    "rl_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 ORDER BY o_orderkey LIMIT 1000",
    "rl_upsert": f"{_PARTS} SELECT k, v, o_totalprice FROM (SELECT *, 0 AS fresh FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC, fresh DESC) = 1",
    "rl_anti_insert": f"{_PARTS} FROM a UNION ALL FROM b WHERE k NOT IN (SELECT k FROM a)",
    "rl_delete_cascade": "SELECT 'parent' AS kind, count(*) AS n FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT 'child', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "rl_constraints": """SELECT 'orders.o_orderkey.unique' AS rule, count(*) AS n_rows FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orders.o_orderstatus.allowed', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'orders.o_orderpriority.allowed', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'orders.o_custkey.refers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""",
    "rl_join": "SELECT c_custkey AS user_id, c_name, o_orderkey AS key_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1999-01-01')",
    "rl_roles": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0",
    "rl_version_gap": f"{_CASES} SELECT case_id, count(DISTINCT version) AS n_versions, min(version) AS first, max(version) AS last FROM c GROUP BY case_id HAVING min(version) <> 1 OR max(version) <> count(DISTINCT version)",
    "rl_next_version": f"{_CASES} SELECT case_id, CASE WHEN case_id % 9 = 0 THEN 1 ELSE min(version) + 1 END AS next_version FROM c GROUP BY case_id",
    "rl_verified": "SELECT o_custkey AS k, max(o_orderkey) IS NOT DISTINCT FROM max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS verified FROM orders GROUP BY o_custkey",
}
