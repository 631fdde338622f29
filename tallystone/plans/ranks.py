"""Queries on order statistics and chi-square tails, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.operators import forensics
from tallystone.operators import ranks as op
from tallystone.session import table


def _lengths(spark, sf_dir):
    """A length a document; one language has over a third of them."""
    return table(spark, sf_dir, "documents").select("lang", F.length("text").alias("size"))


def tl_quantiles(spark, sf_dir):
    return op.quantiles(_lengths(spark, sf_dir), "lang", "size", (0.05, 0.95))


def tl_near_median(spark, sf_dir):
    return op.near_median(_lengths(spark, sf_dir), "lang", "size", 1.5)


def nm_hidden_bits(spark, sf_dir):
    found = forensics.hidden_bits(table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", "text")
    return found.select("key", F.round("chi2", 6).alias("chi2"), "degrees", F.round("p", 9).alias("p"), "detected")


QUERIES = {f.__name__: f for f in (tl_quantiles, tl_near_median, nm_hidden_bits)}

ORACLES = {
    "tl_quantiles": """WITH d AS (SELECT lang, length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), g AS (SELECT lang, count(*) AS n, median(v) AS p50, list_sort(list(v)) AS l, max(v) AS max FROM d GROUP BY lang)
SELECT lang, n, p50, l[least(n, CAST(floor(n * 0.05e0) AS BIGINT) + 1)] AS p5, l[least(n, CAST(floor(n * 0.95e0) AS BIGINT) + 1)] AS p95, max FROM g""",
    "tl_near_median": """WITH d AS (SELECT lang, length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), s AS (SELECT lang, median(v) AS m, stddev_samp(v) AS d FROM d GROUP BY lang)
SELECT d.lang, median(v) AS median, count(*) AS n FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang WHERE s.d IS NULL OR s.d = 0 OR abs(v - m) <= 1.5 * s.d GROUP BY d.lang""",
    # The lower function as one series; it has enough terms for statistics of some thousands.
    "nm_hidden_bits": """WITH t AS (SELECT conv_id * 1000 + turn AS key, hex(encode(coalesce(text, ''))) AS h FROM conversations), b AS (SELECT key, unnest(range(1, length(h), 2)) AS i, h FROM t),
v AS (SELECT key, CAST('0x' || substr(h, i, 2) AS INTEGER) AS v FROM b), p AS (SELECT key, v // 2 AS pair, count(*) FILTER (WHERE v % 2 = 0) AS x, count(*) FILTER (WHERE v % 2 = 1) AS y FROM v GROUP BY ALL),
c AS (SELECT key, sum((x - y) * (x - y) / (x + y)::DOUBLE) AS chi2, CAST(count(*) AS INTEGER) AS degrees FROM p GROUP BY key),
q AS (SELECT t.key, coalesce(chi2, 0) AS chi2, coalesce(degrees, 0) AS degrees, CASE WHEN degrees IS NULL OR chi2 <= 0 THEN 1e0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 4000), lambda k: exp((k + degrees / 2e0) * ln(chi2 / 2e0) - chi2 / 2e0 - lgamma(degrees / 2e0 + k + 1))))) END AS p FROM t LEFT JOIN c USING (key))
SELECT key, round(chi2, 6) AS chi2, degrees, round(p, 9) AS p, p < 1 - 0.95e0 AS detected FROM q""",
}
