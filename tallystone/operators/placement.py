"""Placement, routing, trust, dependency graphs and allocation."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.lineage import cut

LATENCY_WEIGHT, CAPACITY_WEIGHT, UTILISATION_WEIGHT = 0.3, 0.5, 0.2
MAX_NODES = 10_000
CUT_LEVELS = 50


def node_score() -> Column:
    """Nodes have latency_ms, capacity (0 to 1000) and utilisation (0 to 1)."""
    near = F.greatest(F.lit(0.0), 1.0 - F.col("latency_ms") / 100.0)
    return LATENCY_WEIGHT * near + CAPACITY_WEIGHT * (F.col("capacity") / 1000.0) - UTILISATION_WEIGHT * F.col("utilisation")


def best_node(work: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """For each unit of work (key, dt, tu) the node of largest score whose dt and tu suffice, the first among equals; null if none.

    Of nodes with the same dt and tu only the best can win, so different capacities meet different demands, not nodes
    work, and the answer is joined back by demand. The capacities are broadcast up to MAX_NODES; more are left to Spark.
    """
    best_of = lambda: F.max_by(F.struct("score", "node"), F.struct(F.col("score"), (-F.col("node")).alias("first")))
    scored = nodes.withColumn("score", node_score()).groupBy(F.col("dt").alias("_dt"), F.col("tu").alias("_tu")).agg(best_of().alias("_best")).select("_dt", "_tu", "_best.*")
    if scored.limit(MAX_NODES + 1).count() <= MAX_NODES:
        scored = F.broadcast(scored)
    demands = work.select("dt", "tu").distinct()
    fit = demands.join(scored, (F.col("_dt") >= F.col("dt")) & (F.col("_tu") >= F.col("tu")))
    best = fit.groupBy("dt", "tu").agg(best_of().alias("_best")).select("dt", "tu", "_best.node")
    return work.join(best, ["dt", "tu"], "left").select(key, "node")


def routed(jobs: DataFrame, nodes: DataFrame, key: str, chain: int = 3) -> DataFrame:
    """The order of nodes for each kind of job (needs: array of tags): trust, share of tags met and headroom weigh .5, .3 and .2."""
    kinds = jobs.select("needs").distinct()
    met = F.size(F.array_intersect("needs", "tags")) / F.greatest(F.size("needs"), F.lit(1))
    score = F.bround(F.col("trust") * 0.5 + met * 0.3 + F.col("headroom") * 0.2, 9)
    ranked = kinds.join(F.broadcast(nodes) if nodes.limit(MAX_NODES + 1).count() <= MAX_NODES else nodes, F.arrays_overlap("needs", "tags")).withColumn("score", score)
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("needs").orderBy(F.desc("score"), "node"))).where(F.col("_r") <= chain)
    lists = ranked.groupBy("needs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "node"))), lambda x: x["node"].cast("string")), ">").alias("chain"))
    return jobs.join(lists, "needs", "left").select(key, "chain")


def division(offers: DataFrame, needs: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that offer every needed item: relational division by counts."""
    wanted = needs.select(item).distinct()
    total = wanted.count()
    return offers.join(wanted, item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("n")).where(F.col("n") == total).select(key)


def trust(heartbeats: DataFrame, outcomes: DataFrame, key: str, system: list[str]) -> DataFrame:
    """.4 of the success rate (.5 without history), .3 of freshness (a node that is heard of is fresh) and .3 of the
    share of the system's capabilities that the heartbeat (key, capabilities) offers (1 if the system names none)."""
    rate = outcomes.groupBy(key).agg(F.avg(F.col("ok").cast("double")).alias("_rate"))
    breadth = F.size(F.array_intersect("capabilities", F.array(*map(F.lit, sorted({*system}))))) / F.lit(float(len({*system}))) if system else F.lit(1.0)
    return heartbeats.join(rate, key, "left").select(key, F.bround(0.4 * F.coalesce("_rate", F.lit(0.5)) + 0.3 + 0.3 * F.coalesce(breadth, F.lit(0.0)), 4).alias("trust"))


def standing(messages: DataFrame, key: str, order: str) -> DataFrame:
    """After each message (valid or not) the share of valid ones so far and the status: banned at three violations,
    suspect at one while that share is below a half."""
    upto = W.partitionBy(key).orderBy(order)
    rows = messages.withColumn("trust", F.bround(F.avg(F.col("valid").cast("double")).over(upto), 4)).withColumn("violations", F.count_if(~F.col("valid")).over(upto))
    return rows.withColumn("status", F.when(F.col("violations") >= 3, "BANNED").when((F.col("violations") >= 1) & (F.col("trust") < 0.5), "SUSPECT").otherwise("HEALTHY"))


def available(nodes: DataFrame, cooling: DataFrame, now_s: Column, stale_s: int) -> DataFrame:
    """Nodes heard of lately and not cooling down, in order."""
    return nodes.where(now_s - F.col("heard_s") <= stale_s).join(cooling.select("node"), "node", "left_anti").orderBy("node")


def least_loaded(workers: DataFrame, kind: str, limit: int) -> DataFrame:
    """For each kind the worker of least load under the limit, the first among equals."""
    return workers.where(F.col("load") < limit).groupBy(kind).agg(F.min_by("worker", F.struct("load", "worker")).alias("worker"))


def undeclared(edges: DataFrame, declared: DataFrame) -> DataFrame:
    return edges.distinct().join(declared, ["a", "b"], "left_anti")


def version_conflicts(uses: DataFrame, key: str, version: str) -> DataFrame:
    return uses.groupBy(key).agg(F.count_distinct(version).alias("versions"), F.min(version).alias("least"), F.max(version).alias("most")).where("versions > 1")


def reachable_depth(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, depth): the longest path that leads to each node of an acyclic graph (a before b), level by level.

    Each round takes away the nodes without predecessors and their edges, by anti joins over what is left; lineage is
    cut once a round, and the levels found are joined up every CUT_LEVELS rounds. It goes on until no node is free; if
    ``max_rounds`` is given and does not suffice, it raises. Nodes on a cycle or behind one never become free and are reported with a null depth.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    # One table for both: edges have a, nodes have none.
    rest = cut(edges.select("a", F.col("b").alias("node")).distinct().unionByName(nodes.select(F.lit(None).cast(edges.schema["a"].dataType).alias("a"), "node")))
    out = rest.where("a IS NULL").select("node", F.lit(None).cast("int").alias("depth")).limit(0)
    for depth in count():
        ready = rest.groupBy("node").agg(F.count("a").alias("n")).where("n = 0").select("node")
        ready = cut(ready)
        if ready.isEmpty():
            break
        if depth == max_rounds:
            raise RuntimeError(f"the graph is deeper than {max_rounds} levels")
        out = out.unionByName(ready.withColumn("depth", F.lit(depth)))
        if depth % CUT_LEVELS == CUT_LEVELS - 1:
            out = cut(out)
        rest = rest.join(ready, "node", "left_anti").join(ready.select(F.col("node").alias("a")), "a", "left_anti")
        rest = cut(rest.select("a", "node"))
    return out.unionByName(rest.where("a IS NULL").select("node", F.lit(None).cast("int").alias("depth")))


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle or behind one: what is left when nodes without predecessors are taken away again and again."""
    return reachable_depth(edges).where("depth IS NULL").select("node")


def tree_rollup(leaves: DataFrame) -> DataFrame:
    """State of every node of a tree of paths ("0/2/1") from its leaves (path, ok, failed): failed if any leaf failed, done if all are done."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    g = leaves.select(F.explode(prefixes).alias("path"), "ok", "failed").groupBy("path").agg(F.bool_or("failed").alias("failed"), F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("leaves"))
    return g.select("path", F.when(F.col("failed"), "failed").when(F.col("ok"), "done").otherwise("open").alias("state"), "leaves")


def urgency(jobs: DataFrame, limit: int) -> DataFrame:
    """Pending jobs, the most urgent (the smallest score) first: the priority's rank times 1000 and one over the latency
    target, nothing for a target of 0 or less; looser targets therefore come earlier among equals."""
    near = F.when(F.col("target_ms") <= 0, 0.0).otherwise(1.0 / F.greatest(F.col("target_ms"), F.lit(1)))
    return jobs.withColumn("urgency", F.col("priority") * 1000.0 + near).orderBy("urgency", "job").limit(limit)


def due(jobs: DataFrame, now: int, limit: int = 100) -> DataFrame:
    return jobs.where(F.col("due") <= now).orderBy("due", "job").limit(limit)


def gate_order(proposals: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """Proposals with the rank of their kind and a numeric id derived from their text, in order."""
    rank = F.create_map(*(F.lit(x) for kv in priorities.items() for x in kv))
    derived = F.conv(F.substring(F.sha2("proposal", 256), 1, 12), 16, 10).cast("long")
    return proposals.withColumn("priority", F.coalesce(rank[F.col("kind")], F.lit(99))).withColumn("derived", derived).orderBy("priority", "proposal")


def ingress(cases: DataFrame) -> DataFrame:
    """Work coming in: quarantined at a threat of .7, deferred if it costs more energy than is left and less than .3 of
    the budget is left, else permitted. No known budget is no limit."""
    short = (F.col("remaining_j") < F.col("cost_j")) & (F.col("remaining_j") / F.col("budget_j") < 0.3)
    return cases.withColumn("verdict", F.when(F.col("threat") >= 0.7, "quarantine").when(F.coalesce(short, F.lit(False)), "defer").otherwise("permit"))


def egress(cases: DataFrame, own: str) -> DataFrame:
    """Results going out: classified ones leave for no other node (``own`` names the column of this one), nor do results
    whose chain of provenance is longer than ten."""
    leaves = (F.col("sensitivity") == "classified") & (F.col("destination") != F.col(own))
    reason = F.when(leaves, "classified_to_external").when(F.col("chain_length") > 10, "provenance_chain_too_long")
    return cases.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "permit").otherwise("reject"))


def torque(rows: DataFrame, group: str, available: float, floor: float) -> DataFrame:
    """Shares of what is available in proportion to priority * efficiency * requested; the rest is banked.

    Rows that request something get the floor at least; what that takes is reclaimed from shares above the floor in
    proportion to their excess, or, if those don't suffice, from all. Shares are clamped to 0 to 1 and scaled down to
    the total. A group's sums are aggregates joined back, so a group of any size is divided in parallel.
    """
    tiny = 1e-6
    total = F.lit(float(available))

    def with_sums(df: DataFrame, **sums: Column) -> DataFrame:
        return df.join(df.groupBy(group).agg(*(F.sum(c).alias(n) for n, c in sums.items())), group)

    weight = F.col("priority") * F.col("efficiency") * F.col("requested")
    out = with_sums(rows.withColumn("_w", weight), _sum=F.greatest(F.col("_w"), F.lit(0.0)))
    demand = F.col("_sum") > tiny
    active = demand & (F.col("requested") > tiny)
    raw = F.when(active, F.col("_w") / F.col("_sum") * total).otherwise(0.0)
    out = out.withColumn("_active", active).withColumn("_raw", raw).withColumn("_short", F.when(active, F.greatest(F.lit(0.0), F.lit(floor) - raw)).otherwise(0.0))
    out = out.withColumn("_raw", F.when(F.col("_active"), F.greatest(F.col("_raw"), F.lit(floor))).otherwise(0.0))
    out = with_sums(out.withColumn("_over", F.when(F.col("_active"), F.col("_raw") - floor).otherwise(0.0)), _extra=F.col("_short"), _spare=F.col("_over"))
    mended = (
        F.when((F.col("_extra") <= tiny) | ~F.col("_active"), F.col("_raw"))
        .when(F.col("_spare") >= F.col("_extra"), F.col("_raw") - F.col("_over") * (F.col("_extra") / F.col("_spare")))
        .otherwise(F.col("_raw") * (total / (total + F.col("_extra"))))
    )
    out = with_sums(out.withColumn("_share", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mended))), _used=F.col("_share"))
    scale = F.when((F.col("_used") > total) & (total > tiny), total / F.col("_used")).otherwise(1.0)
    banked = F.greatest(F.lit(0.0), total - F.col("_used") * scale)
    return out.select(*rows.columns, (F.col("_share") * scale).alias("share"), banked.alias("banked"))


def select_model(models: DataFrame, requests: DataFrame) -> DataFrame:
    """For each vertical and wanted tier the model of least id: of the wanted tier if there is one, else of any."""
    both = requests.join(models.withColumnRenamed("tier", "_tier"), "vertical")
    best = F.min_by("model", F.struct((F.col("_tier") != F.col("tier")).alias("other"), "model"))
    return both.groupBy("vertical", "tier").agg(best.alias("model"))


def active_treaties(parties: DataFrame, signatures: DataFrame) -> DataFrame:
    """Treaties all of whose parties have signed."""
    open_ = parties.join(signatures, ["treaty", "party"], "left_anti").select("treaty").distinct()
    return parties.select("treaty").distinct().join(open_, "treaty", "left_anti")


def vram_fit(nodes: DataFrame, need: int) -> DataFrame:
    best = nodes.agg(F.max_by(F.struct("node", "free"), F.struct("free", "node")).alias("b"))
    return best.select("b.node", F.when(F.col("b.free") >= need, "full").when(F.col("b.free") > 0, "partial").otherwise("none").alias("fit"))


def with_state(nodes: DataFrame, states: DataFrame) -> DataFrame:
    return nodes.join(states, "node", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def all_sources(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
