"""Queries on cycles of directed graphs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import graphs as op
from tallystone.session import table


def _edges(spark, sf_dir):
    """Documents point at others of their block of 30, which makes cycles, and some at a later block, which makes none."""
    p = F.col("doc_id").cast("long")
    block, i = F.floor(p / 30), p % 30
    targets = F.array_compact(
        F.array(
            F.when(p % 4 != 0, block * 30 + (i * 7 + 3) % 30),
            F.when(p % 3 == 1, block * 30 + (i * i + block) % 30),
            F.when(p % 6 == 0, p + 31),
            F.when((i == 0) & (block % 5 == 2), p),
        )
    )
    return table(spark, sf_dir, "documents").select(p.alias("a"), F.explode(targets).alias("b"))


def pl_components(spark, sf_dir):
    return op.components(_edges(spark, sf_dir))


def pl_witnesses(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return op.witnesses(edges, op.components(edges))


# Edges that leave a block go up, so no cycle has one, and reach is looked for inside blocks alone.
_REACH = """WITH RECURSIVE p AS (SELECT doc_id AS p, doc_id // 30 AS k, doc_id % 30 AS i FROM documents), e AS (
  SELECT p AS a, k * 30 + (i * 7 + 3) % 30 AS b FROM p WHERE p % 4 <> 0 UNION SELECT p, k * 30 + (i * i + k) % 30 FROM p WHERE p % 3 = 1 UNION SELECT p, p FROM p WHERE i = 0 AND k % 5 = 2
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), s AS MATERIALIZED (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.b = y.a AND y.b = x.a GROUP BY x.a)"""

QUERIES = {f.__name__: f for f in (pl_components, pl_witnesses)}

ORACLES = {
    "pl_components": f"{_REACH} FROM s",
    "pl_witnesses": f"""{_REACH}, inside AS MATERIALIZED (SELECT DISTINCT f.component, a, b FROM e JOIN s f ON f.node = a JOIN s t ON t.node = b AND t.component = f.component),
walk AS (SELECT component, component AS node, 0 AS d FROM s WHERE node = component UNION SELECT w.component, b, d + 1 FROM walk w JOIN inside i ON i.component = w.component AND i.a = w.node WHERE d < 30 AND b <> w.component),
near AS MATERIALIZED (SELECT component, node, min(d) AS d FROM walk GROUP BY ALL),
last AS (SELECT n.component, min(d) AS d FROM near n JOIN inside i ON i.component = n.component AND i.a = n.node AND i.b = n.component GROUP BY n.component),
ends AS (SELECT l.component, l.d, min(n.node) AS node FROM last l JOIN near n USING (component, d) JOIN inside i ON i.component = n.component AND i.a = n.node AND i.b = n.component GROUP BY ALL),
up AS (SELECT component, d AS position, node FROM ends UNION ALL
  SELECT component, position, min(node) FROM (SELECT u.component, u.position - 1 AS position, i.a AS node FROM up u JOIN inside i ON i.component = u.component AND i.b = u.node JOIN near n ON n.component = i.component AND n.node = i.a AND n.d = u.position - 1) GROUP BY ALL)
SELECT component, position, node FROM up""",
}
