"""Cycles of directed graphs, told apart as strongly connected components.

Nothing walks node by node on the driver: every round is a join of edges with labels and an aggregate that combines
before its shuffle, and lineage is cut after it. Edges have ``a`` and ``b`` (from a to b); null ends are left out.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.lineage import cut

#: Rounds in which nodes without predecessors or successors are taken away first; what is left of them later costs rounds, not results.
TRIMS = 4
#: Rounds after which what was found in them is stored as one.
CUT_ROUNDS = 8


def _trimmed(edges: DataFrame, rounds: int = TRIMS) -> tuple[DataFrame, int]:
    """Edges whose nodes have both a predecessor and a successor, after so many rounds at most, and their number."""
    n = edges.count()
    for _ in range(rounds):
        if not n:
            break
        goes, comes = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = cut(edges.join(goes, "b", "left_semi").join(comes, "a", "left_semi").select("a", "b"), n)
        before, n = n, edges.count()
        if n == before:
            break
    return edges, n


def _least_ancestors(edges: DataFrame, n: int) -> DataFrame:
    """(node, color): the least node that leads to each node, itself included."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    colors = cut(nodes.withColumn("color", F.col("node")), n)
    fresh = colors
    while True:
        # Only labels that fell in the last round can make others fall.
        sent = edges.join(fresh, edges["a"] == fresh["node"]).groupBy(F.col("b").alias("node")).agg(F.min("color").alias("new"))
        joined = cut(colors.join(sent, "node", "left").select("node", F.least("color", "new").alias("color"), (F.col("new") < F.col("color")).alias("fell")), n)
        colors, fresh = joined.select("node", "color"), joined.where("fell").select("node", "color")
        if fresh.isEmpty():
            return colors


def _leading_to_their_color(edges: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(node, color) of the nodes from which edges of their own color lead to the color's root."""
    fresh = reached = roots
    while True:
        back = edges.join(fresh.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "color").distinct()
        fresh = cut(back.join(reached, "node", "left_anti"), n)
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh), n)


def components(edges: DataFrame) -> DataFrame:
    """node and component of every node that lies on a cycle; a component is named by its least node.

    Nodes of one color (the least node that leads to them) hold whole components, and those of the color's root are the
    ones that lead back to it; the others go on with the edges of one color alone. A node with an edge to itself is on a
    cycle. Nodes that only follow or precede a cycle are in no component. Rounds grow with the longest shortest path.
    """
    edges = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    rest = edges.where("a <> b")
    found = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    while True:
        rest, n = _trimmed(rest)  # nodes are no more than edges then
        if not n:
            break
        colors = _least_ancestors(rest, n)
        ends = rest.join(colors.withColumnRenamed("node", "a"), "a").join(colors.select(F.col("node").alias("b"), F.col("color").alias("_other")), "b")
        inside = cut(ends.where("color = _other").select("a", "b", "color"), n)
        reached = _leading_to_their_color(inside, colors.where("node = color"), n)
        cyclic = reached.join(reached.where("node <> color").select("color").distinct(), "color", "left_semi")
        found = found.unionByName(cyclic.select("node", F.col("color").alias("component")))
        done = reached.select("node")
        rest = cut(inside.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), n)
    return cut(found.groupBy("node").agg(F.min("component").alias("component")))


def witnesses(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, position (from 0) and node: one shortest cycle through each component's least node, that node first.

    Of several predecessors the least is taken. ``members`` is what ``components`` gave.
    """
    of = lambda end: members.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    inside = edges.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").where("_a = _b").select(F.col("_a").alias("component"), "a", "b")
    inside = cut(inside)
    n = inside.count()
    fresh = members.where("node = component").select("component", "node", F.col("node").alias("parent"), F.lit(0).alias("distance"))
    seen = fresh = cut(fresh, n)
    for distance in count(1):
        ahead = inside.join(fresh.select("component", F.col("node").alias("a")), ["component", "a"])
        onward = ahead.groupBy("component", F.col("b").alias("node")).agg(F.min("a").alias("parent"), F.lit(distance).alias("distance"))
        fresh = cut(onward.join(seen.select("component", "node"), ["component", "node"], "left_anti"), n)
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if distance % CUT_ROUNDS == 0:
            seen = cut(seen, n)
    seen = cut(seen, n)
    # The nearest node with an edge back to the least one closes the cycle.
    back = inside.where("b = component").select("component", F.col("a").alias("node")).join(seen, ["component", "node"])
    closed = cut(back.groupBy("component").agg(F.min(F.struct("distance", "node")).alias("_e")).select("component", "_e.node", F.col("_e.distance").alias("last")), n)
    # All ancestors of the closing nodes: jumps of 1, 2, 4, ... steps up the tree.
    longest = closed.agg(F.max("last")).first()[0] or 0
    path, jump = closed.select("component", "node"), seen.select("component", "node", "parent")
    for _ in range(longest.bit_length()):
        path = cut(path.unionByName(path.join(jump, ["component", "node"]).select("component", F.col("parent").alias("node"))).distinct(), n)
        further = jump.select("component", F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jump = cut(jump.join(further, ["component", "parent"]).select("component", "node", F.col("_up").alias("parent")), n)
    return path.join(seen, ["component", "node"]).select("component", F.col("distance").alias("position"), "node")
