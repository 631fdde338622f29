"""Connected components of a table of links, as DataFrame joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import cut
from tallystone.session import share_package

MAX_ROUNDS = 60
#: So many links (16 bytes each) are settled in one task; more of them in rounds over all tasks, with the same result.
ONE_TASK = 500_000


def least_reached(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n positions the least position that it reaches over the links."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, before[left])
        least = least[least]
        if (least == before).all():
            return least


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if links:
        a, b = (np.concatenate(side) for side in zip(*links, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[least_reached(len(nodes), at[: len(a)], at[len(a) :])]
        tied = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(root[tied])], names=["node", "root"])


def smallest_reachable(links: DataFrame, rows: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): for each node in ``links`` (a, b, both long) but roots, the smallest node that it reaches.

    ``rows`` is how many links are expected, if known, and decides on files only.

    Alternates the large-star and small-star steps: every node sends its larger (then its smaller) neighbours to the
    least neighbour it knows, until the links form stars. Each step is one aggregate and one join on the node, so a hub
    with very many links is split by Spark's skew handling and never gathered. Links of a node to itself are ignored.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    n = edges.count()
    if n <= one_task:
        share_package(links.sparkSession)
        return edges.coalesce(1).mapInArrow(_settled, "node long, root long")
    mark = None
    for _ in range(MAX_ROUNDS):
        # Large star: each node ties its larger neighbours to the least of itself and its neighbours.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node ties itself and its smaller neighbours to the least of them.
        up = cut(up.where("a <> b").distinct(), n)
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(down.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), n)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
