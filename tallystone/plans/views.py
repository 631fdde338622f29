"""Views of the test tables in the shapes that the operators take, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.session import table

NOW = "2024-02-01 00:00:00"


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence streams derived from ``events``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("stream_id"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("subject"),
        (1 + F.col("user_id") % 5).cast("int").alias("source_tier"),
        F.when(i % 3 == 0, "positive").when(i % 3 == 1, "negative").otherwise("neutral").alias("claim"),
        ((i % 100) / 100.0).alias("confidence"),
        ((i * 7 % 100) / 100.0).alias("severity_impact"),
        F.col("ts"),
        F.when(i % 4 != 0, (24.0 * (1 + F.col("user_id") % 5))).alias("half_life"),
        F.concat_ws("-", F.col("user_id"), F.floor(F.col("value") / 10)).alias("provenance_hash"),
        F.when(i % 7 != 0, i % 11 != 0).alias("signature_valid"),
    )


STREAMS = """
streams AS (
  SELECT event_id AS stream_id, event_type AS type, user_id AS subject, CAST(1 + user_id % 5 AS INTEGER) AS source_tier,
    CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS claim,
    (event_id % 100) / 100e0 AS confidence, (event_id * 7 % 100) / 100e0 AS severity_impact, ts,
    CASE WHEN event_id % 4 <> 0 THEN 24e0 * (1 + user_id % 5) END AS half_life,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS provenance_hash,
    CASE WHEN event_id % 7 <> 0 THEN event_id % 11 <> 0 END AS signature_valid
  FROM events
)"""
