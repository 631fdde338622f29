"""Approximate nearest neighbours over learned partitions.

Fitting: the nearest-neighbour graph of a bounded sample (about ``SAMPLE`` vectors, drawn by a hash of vec_id) is cut
into balanced parts by recursive bisection with swaps that lower the number of cut edges, and a small classifier (one
hidden layer) learns each vector's part and those of its neighbours. Indexing: every vector goes to its most probable
part. Searching: a query goes to its most probable parts until their probabilities reach ``COVER``, at least ``PROBES``
of them; the vectors there are ranked by exact cosine in double precision.

Parts of more vectors than the sample can tell apart are cut again: each has a router of its own, fitted in a task on a
bounded sample of the part (``MAX_PARTS`` routers at most, some 100 KB each, which are broadcast), so that there are up
to ``MAX_PARTS`` squared parts, of ``PART_ROWS`` vectors each as long as these suffice (12.6 million vectors). A query then goes to the most probable of them by the product of both probabilities.

Parts are searched in blocks: a part of many vectors (one vector may make up a third of the table) or of many queries
is split, every block of its queries meets every block of its vectors, and the best of each pair are merged per query.
The number of parts follows the root of the number of vectors, so tables of some hundred go through the router like any.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, neither do null ids nor
vectors of another length than most; fewer candidates than ``k`` give all of them; equal cosines are ordered by vec_id;
repeated rows are repeated candidates, but rows with the query's own id are not its candidates; a query row that is
repeated is answered once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import cut
from tallystone.session import share_package

SAMPLE = 8_192
NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 30
PART_ROWS = 768
MAX_PARTS = 128
#: Parts are numbered by their first part times this and the part inside it.
STRIDE = 1024
COVER = 0.98
PROBES = 2
BLOCK_ROWS = 1_024
BLOCK_QUERIES = 1_024
_GRAIN = 1 << 30


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row, by dot product; computed in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        dots = x[at : at + 1024] @ x.T
        dots[np.arange(len(dots)), np.arange(at, at + len(dots))] = -np.inf
        out[at : at + 1024] = np.argpartition(-dots, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, x: np.ndarray, sources: np.ndarray, targets: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A balanced two-way split of ``nodes`` (True: second half) with few edges between the halves."""
    centred = x[nodes] - x[nodes].mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    side = np.zeros(len(nodes), bool)
    side[np.argsort(centred @ axes[:, -1], kind="stable")[len(nodes) // 2 :]] = True
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    inside = (place[sources] >= 0) & (place[targets] >= 0)
    a, b = place[sources[inside]], place[targets[inside]]
    for step in range(rounds):
        apart = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, apart, len(nodes)) + np.bincount(b, apart, len(nodes))
        left, right = (part[np.argsort(-gain[part], kind="stable")] for part in (np.flatnonzero(~side), np.flatnonzero(side)))
        n = min(len(left), len(right))
        swaps = int(np.sum(gain[left[:n]] + gain[right[:n]] > 0) / (1 + step / 2))
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row; ``parts`` is a power of two."""
    sources, targets = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    part = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            nodes = np.flatnonzero(part == p)
            if len(nodes) > 1:
                part[nodes] = p + size * _bisect(nodes, x, sources, targets)
        size *= 2
    return part


@dataclass
class Router:
    """A network of one hidden layer that gives the parts' probabilities; ``children`` route within some of them."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    children: dict[int, Router] = field(default_factory=dict)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, aim: np.ndarray, seed: int = 7) -> Router:
    """Adam on the cross entropy to ``aim``, the wanted probabilities of each row."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5 * 4, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, aim.shape[1])), np.zeros(aim.shape[1])]
    weights = [w.astype(np.float32) for w in weights]
    means, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            h = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - aim[rows]) / len(rows)
            back = (d @ weights[2].T) * (h > 0)
            step += 1
            rate = 0.004 * (1 - epoch / EPOCHS)
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                means[i] += 0.1 * (g - means[i])
                squares[i] += 0.001 * (g * g - squares[i])
                weights[i] -= rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit_router(x: np.ndarray, parts: int) -> Router:
    """The router of unit vectors ``x`` into ``parts`` parts."""
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    aim = np.zeros((len(x), parts), np.float32)
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    np.add.at(aim, (rows, part[graph.ravel()]), 0.5 / max(1, graph.shape[1]))
    aim[np.arange(len(x)), part] += 1 - aim.sum(axis=1)
    return train_router(x, aim)


def probed_parts(probabilities: np.ndarray, cover: float = COVER, probes: int = PROBES) -> list[np.ndarray]:
    """For each row the most probable parts until ``cover`` is reached, at least ``probes``."""
    order = np.argsort(-probabilities, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(probabilities, order, axis=1), axis=1)
    n = np.maximum(probes, 1 + (reached < cover).sum(axis=1))
    return [row[: min(m, len(row))] for row, m in zip(order, n, strict=True)]


def _within(router: Router, x: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
    """For each part the places in ``rows`` that go there, and the probabilities inside it (None if it isn't cut)."""
    for part in np.unique(parts):
        at = np.flatnonzero(parts == part)
        child = router.children.get(int(part))
        yield at, int(part), child.probabilities(x[rows[at]]) if child else None


def home(router: Router, x: np.ndarray) -> np.ndarray:
    """The number of each row's most probable part."""
    parts = router.probabilities(x).argmax(axis=1)
    out = parts * STRIDE
    for at, _, inside in _within(router, x, np.arange(len(x)), parts):
        if inside is not None:
            out[at] += inside.argmax(axis=1)
    return out


def probed(router: Router, x: np.ndarray, cover: float = COVER, probes: int = PROBES) -> list[list[int]]:
    """For each row the numbers of the parts to search: the most probable ones until ``cover`` is reached, at least ``probes``."""
    p = router.probabilities(x)
    chosen = probed_parts(p, cover, probes)
    rows, parts = np.repeat(np.arange(len(x)), [len(c) for c in chosen]), np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)
    found: list[list[tuple[float, int]]] = [[] for _ in range(len(x))]
    for at, part, inside in _within(router, x, rows, parts):
        for i, row in enumerate(rows[at]):
            found[row] += [(-float(p[row, part]), part * STRIDE)] if inside is None else [(-float(p[row, part] * q), part * STRIDE + j) for j, q in enumerate(inside[i])]
    out = []
    for pairs in found:
        pairs.sort()
        reached = np.cumsum([-q for q, _ in pairs])
        out.append([part for _, part in pairs[: max(probes, 1 + int((reached < cover * reached[-1]).sum()))]])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    x = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select("vec_id", x).where(F.col("vec_id").isNotNull() & ~F.exists(x, odd) & F.exists(x, lambda v: v != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    # The largest component first, so that neither very large nor very small vectors leave the range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, sample: int = SAMPLE, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> Router | None:
    """The router fitted on about ``sample`` vectors, into about half as many parts as the root of their number, at most
    ``max_parts``; None for fewer vectors than two parts need."""
    total = vectors.count()
    if not total:
        return None
    parts = min(max_parts, 1 << max(1, round(math.log2(math.sqrt(total) / 2))))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(_GRAIN)) < int(min(1.0, sample / total) * _GRAIN))
    x = np.unique(_unit(_matrix(drawn.select("embedding").toArrow().column(0).combine_chunks())), axis=0)  # copies count once
    router = _fitted(x, parts)
    if router is None or parts < max_parts or total <= 2 * parts * part_rows:
        return router
    sizes = {r["part"] // STRIDE: r["count"] for r in routed(vectors, router).groupBy("part").count().collect()}  # a row a part
    large = {part: n for part, n in sizes.items() if n > 2 * part_rows}
    if large:
        share = F.create_map(*(F.lit(v) for part, n in sorted(large.items()) for v in (part, int(min(1.0, sample / n) * _GRAIN))))
        inside = routed(vectors, router).select((F.col("part") / STRIDE).cast("int").alias("part"), "vec_id", "embedding", share[(F.col("part") / STRIDE).cast("int")].alias("share"))
        some = inside.where(F.pmod(F.xxhash64(F.lit("inside"), "vec_id"), F.lit(_GRAIN)) < F.col("share")).dropDuplicates(["part", "embedding"]).select("part", "embedding")
        counts = {part: min(max_parts, 1 << (n // part_rows).bit_length()) for part, n in large.items()}

        def child(rows: pa.Table) -> pa.Table:
            part = rows.column("part")[0].as_py()
            found = _fitted(np.unique(_unit(_matrix(rows.column("embedding").combine_chunks())), axis=0), counts[part])
            weights = [pickle.dumps(found)] if found else []
            return pa.table([pa.array([part] * len(weights), pa.int32()), pa.array(weights, pa.binary())], names=["part", "router"])

        share_package(vectors.sparkSession)
        router.children = {r["part"]: pickle.loads(r["router"]) for r in some.groupBy("part").applyInArrow(child, "part int, router binary").collect()}
    return router


def _fitted(x: np.ndarray, parts: int) -> Router | None:
    """A router of unit vectors into ``parts`` parts, or as many as they can tell apart; None for one."""
    while parts > 1 and parts * 16 > len(x):
        parts //= 2
    return fit_router(x, parts) if parts > 1 else None


def _routed_batches(batches: Iterator[pa.RecordBatch], shared, cover: float | None, probes: int) -> Iterator[pa.RecordBatch]:
    router: Router | None = shared.value
    for batch in batches:
        if router is None or not batch.num_rows:
            found = [[0]] * batch.num_rows
        else:
            x = _unit(_matrix(batch.column("embedding")))
            found = home(router, x)[:, None].tolist() if cover is None else probed(router, x, cover, probes)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(found, pa.list_(pa.int32()))], names=["vec_id", "embedding", "parts"])


def routed(vectors: DataFrame, router: Router | None, cover: float | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, embedding and part: the most probable part or, with ``cover``, a row for each part to probe."""
    spark = vectors.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(router)  # at most MAX_PARTS + 1 networks of two small matrices
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    found = vectors.mapInArrow(lambda b: _routed_batches(b, shared, cover, probes), f"{kinds}, parts array<int>")
    return found.select("vec_id", "embedding", F.explode("parts").alias("part"))


def best_of_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best vectors of a block for each query of a block: query_id, query_key, vec_id, score."""
    ids = vectors.column("vec_id").to_numpy()
    q_ids = queries.column("vec_id").to_numpy()
    out: list[list] = [[], [], [], []]
    if len(ids) and len(q_ids):
        x, q = (_matrix(t.column("embedding").combine_chunks()) for t in (vectors, queries))
        near = _unit(q) @ _unit(x).T
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        norms = np.sqrt((x * x).sum(axis=1))
        m = min(k, len(ids))
        least = -np.partition(-near, m - 1, axis=1)[:, m - 1]
        for i, key in enumerate(queries.column("query_key").to_numpy()):
            # The product's last digits depend on a vector's place in the block: what is near the k-th is measured again.
            at = np.flatnonzero((near[i] >= least[i] - 1e-9) & (near[i] > -np.inf))
            score = (x[at] * q[i]).sum(axis=1) / (norms[at] * np.sqrt((q[i] * q[i]).sum()))
            best = np.lexsort((ids[at], -score))[:k]
            out[0] += [q_ids[i]] * len(best)
            out[1] += [key] * len(best)
            out[2] += ids[at[best]].tolist()
            out[3] += score[best].tolist()
    names = ["query_id", "query_key", "vec_id", "score"]
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, router: Router | None = None, cover: float = COVER, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the ``k`` nearest vectors found for each query.

    Both tables hold vec_id and embedding as ``usable`` gives them; ``router`` is what ``fit`` gave for ``vectors``.
    """
    as_long = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    index = cut(routed(as_long(vectors), router).withColumn("row", F.monotonically_increasing_id()))
    asked = cut(routed(as_long(queries).dropDuplicates(), router, cover, probes).withColumn("query_key", F.xxhash64("embedding")).withColumn("row", F.col("query_key")))
    # One row a part.
    blocks = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("v_blocks"))
    asks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    sizes = F.broadcast(blocks.join(asks, "part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(F.lit("block"), "row"), F.col(n)).cast("int")
    v = index.join(sizes, "part").select("part", own("v_blocks").alias("v"), upto("q_blocks").alias("q"), "vec_id", "embedding")
    q = asked.join(sizes, "part").select("part", upto("v_blocks").alias("v"), own("q_blocks").alias("q"), "vec_id", "embedding", "query_key")
    share_package(vectors.sparkSession)
    found = (
        q.groupBy("part", "v", "q")
        .cogroup(v.groupBy("part", "v", "q"))
        .applyInArrow(lambda a, b: best_of_block(a, b, k), "query_id long, query_key long, vec_id long, score double")
    )
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
