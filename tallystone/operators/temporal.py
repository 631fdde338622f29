"""Temporal anomalies of artifacts and the fusion of their timelines. The clock is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.scalars import micros, stable_id

SEVERITIES = ["critical", "high", "medium", "low"]
BACKDATED_S, SKEW_S = 86_400, 300


def scrubbed(artifacts: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Artifacts without a single temporal event."""
    return artifacts.join(events.select(key), key, "left_anti")


def impossible_sequence(events: DataFrame, key: str) -> DataFrame:
    """Modifications before any creation of their artifact (kind created or modified)."""
    created = events.where("kind = 'created'").groupBy(key).agg(F.max("ts").alias("created"))
    return events.where("kind = 'modified'").join(created, key).where("ts < created")


def future_dated(rows: DataFrame, now: str) -> DataFrame:
    return rows.where(F.col("ts") > F.lit(now).cast("timestamp_ntz"))


def backdated(rows: DataFrame, born: str, created: str) -> DataFrame:
    """Rows whose file was born more than a day after its stated creation."""
    gap = (micros(F.col(born)) - micros(F.col(created))) / 1_000_000
    return rows.withColumn("gap_s", gap).where(F.col("gap_s") > BACKDATED_S)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_after_hours(ts: Column) -> Column:
    return (F.hour(ts) < 7) | (F.hour(ts) >= 18)


def zone_conflicts(rows: DataFrame, key: str, zone: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(zone).alias("zones")).where("zones > 1")


def anomaly(rows: DataFrame, kind: str, severity: str, key: str) -> DataFrame:
    """Findings with a stable id and the rank of their severity."""
    return rows.select(
        stable_id(F.lit(kind), F.col(key), length=16).alias("anomaly_id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(SEVERITIES.index(severity)).alias("rank"), F.col(key).alias("subject")
    )


def fused_timeline(*sources: DataFrame) -> DataFrame:
    """Entries (source, id, ts, what) of several sources in one order; equal instants by source and id."""
    return reduce(DataFrame.unionByName, sources).orderBy("ts", "source", "id")


def entry_label(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-%04d", prefix, number)


def first_inversion(events: DataFrame, key: str) -> DataFrame:
    """For each source the first creation that comes after one of its modifications."""
    earliest = events.where("kind = 'modified'").groupBy(key).agg(F.min("ts").alias("modified"))
    late = events.where("kind = 'created'").join(earliest, key).where("ts > modified")
    return late.groupBy(key).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def parse_pdf_date(text: Column) -> Column:
    """A timestamp from D:YYYYMMDDHHmmSS with an optional offset (+, - or Z); missing parts are the first of their kind."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([+\-Z])?(?:([0-9]{2})'?([0-9]{2})?)?", i), F.lit("")), F.lit(default))
    local = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(1, ""), part(2, "01"), part(3, "01")), F.concat_ws(":", part(4, "00"), part(5, "00"), part(6, "00"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    minutes = part(8, "0").cast("int") * 60 + part(9, "0").cast("int")
    shift = F.when(part(7, "Z") == "+", -minutes).when(part(7, "Z") == "-", minutes).otherwise(0)
    return local + F.make_dt_interval(F.lit(0), F.lit(0), shift)


def parse_mail_date(text: Column) -> Column:
    """A timestamp from an RFC 2822 date, null where it can't be read."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    return F.try_to_timestamp(stripped, F.lit("d MMM yyyy HH:mm:ss Z"))


def spans(events: DataFrame, key: str) -> DataFrame:
    """Earliest, latest and the seconds between, for each artifact."""
    out = events.groupBy(key).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("seconds", (micros(F.col("latest")) - micros(F.col("earliest"))) / 1_000_000)


def best_timestamp(*candidates: Column) -> Column:
    """The first candidate text that is a timestamp."""
    return F.coalesce(*(F.try_to_timestamp(c) for c in candidates))


def instant_anomalies(rows: DataFrame, key: str, ts: str, source: str, now: str) -> DataFrame:
    """Findings (id, subject, kind, severity, confidence) on one instant of each row: in the future, on a weekend, out of hours."""
    at = F.col(ts)
    checks = [
        ("future_dated", "critical", 0.95, at > F.lit(now).cast("timestamp_ntz")),
        ("weekend", "medium", 0.7, is_weekend(at)),
        ("after_hours", "medium", 0.6, is_after_hours(at)),
    ]
    found = F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"))) for kind, severity, sure, test in checks))
    rows = rows.select(F.col(key).alias("subject"), F.explode(F.array_compact(found)).alias("f")).select("subject", "f.*")
    return rows.select(stable_id(F.lit(source), F.col("kind"), F.col("subject"), length=16).alias("anomaly_id"), "subject", "kind", "severity", "confidence")
