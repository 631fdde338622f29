"""Chunks of texts and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 2_048


def chunks(docs: DataFrame, key: str, text: str, size: int = 300, overlap: int = 30) -> DataFrame:
    """key, n, words, chunk and chunk_id of every piece of ``size`` words, each ``overlap`` words into the one before.

    The last may lie wholly inside the one before. A text without words has no chunk.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
    rows = rows.select(key, "w", F.posexplode(starts).alias("n", "at")).select(key, "n", F.slice("w", F.col("at") + 1, F.lit(size)).alias("w"))
    chunk = F.array_join("w", " ")
    return rows.select(key, "n", F.size("w").alias("words"), chunk.alias("chunk"), F.sha2(F.concat_ws(":", key, "n", F.sha2(chunk, 256)), 256).alias("chunk_id"))


def new_chunks(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("chunk_id"), "chunk_id", "left_anti")


def _block(ids: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, rank, vec_id and distance of the k nearest other vectors, exactly; ties go to the smaller id.

    ``metric`` is squared Euclidean distance (l2) or one less the cosine. Vectors and queries (vec_id, embedding) are
    dealt in blocks of about BLOCK rows; each block of queries meets each block of vectors in one task, which passes on
    k rows a query.
    """
    n, m = (max(1, -(-df.count() // BLOCK)) for df in (vectors, queries))
    v = vectors.select(_block(F.col("vec_id"), n).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("q"), "vec_id", "embedding")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("v"), _block(F.col("vec_id"), m).alias("q"), "vec_id", "embedding")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids = b.column("vec_id").to_numpy()
            x = np.stack(b.column("embedding").to_numpy()).astype(np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            for query, vec in zip(a.column("vec_id").to_pylist(), a.column("embedding").to_numpy(), strict=True):
                y = vec.astype(np.float64)
                d = ((x - y) ** 2).sum(axis=1) if metric == "l2" else 1 - (x * y).sum(axis=1) / (norms * np.sqrt((y * y).sum()))
                d[ids == query] = np.inf
                order = np.lexsort((ids, d))[:k]
                out += [(query, int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    found = q.groupBy("v", "q").cogroup(v.groupBy("v", "q")).applyInArrow(best, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
