"""Telemetry reports: runs, buckets, nearest-rank percentiles, rollups, decisions and comparisons.

Everything is grouped aggregation over explicit keys. Exact percentiles of a group use counted distinct values, which
combines before the shuffle: ``exact_ranks`` then orders a group's different values in one task each, and Spark's own
percentile keeps their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed limits of the run buckets.
HEAVY_STATION_MS, HEAVY_TOKENS = 30_000, 8_000
TRIVIAL_STATIONS, TRIVIAL_TOKENS, MICRO_STATIONS, MICRO_TOKENS, MICRO_STATION_MS = 1, 500, 2, 2_000, 5_000
BUCKETS = ["trivial", "micro_solvable", "structured_final", "heavy"]
MIN_FAILS = 20


def assemble_runs(events: DataFrame) -> DataFrame:
    """One row a run from its events (run_id, seq, kind, tokens, ms, ok, checks): the last outcome wins, parts are counted.

    ``checks`` are a part's flags m1 to m4 (array of booleans, null where it has none); a false one marks the run.
    """
    outcome = F.col("kind") == "outcome"
    part = F.col("kind") == "station"
    if "checks" not in events.columns:
        events = events.withColumn("checks", F.lit(None).cast("array<boolean>"))
    return events.groupBy("run_id").agg(
        F.max_by(F.when(outcome, F.col("ok")), F.when(outcome, F.col("seq"))).alias("ok"),
        F.max_by(F.when(outcome, F.col("tokens")), F.when(outcome, F.col("seq"))).alias("total"),
        F.sum(F.when(part, F.col("tokens"))).alias("parts_total"),
        F.count_if(part).alias("n_stations"),
        F.max(F.when(part, F.col("ms"))).alias("max_ms"),
        F.sum(F.when(part, F.col("ms"))).alias("elapsed_ms"),
        F.count_if(outcome).alias("n_outcomes"),
        F.count_if(part & F.coalesce(F.array_contains("checks", False), F.lit(False))).alias("n_failed_checks"),
    )


def total_tokens() -> Column:
    """The outcome's total unless it is null or 0, else the sum of the parts."""
    return F.coalesce(F.nullif(F.col("total"), F.lit(0)), F.col("parts_total"), F.lit(0))


def run_bucket() -> Column:
    tokens, ms = total_tokens(), F.coalesce(F.col("max_ms"), F.lit(0))
    return (
        F.when((F.col("n_failed_checks") > 0) | ~F.coalesce(F.col("ok"), F.lit(True)) | (ms > HEAVY_STATION_MS) | (tokens > HEAVY_TOKENS), "heavy")
        .when((F.col("n_stations") <= TRIVIAL_STATIONS) & (tokens <= TRIVIAL_TOKENS), "trivial")
        .when((F.col("n_stations") <= MICRO_STATIONS) & (tokens <= MICRO_TOKENS) & (ms <= MICRO_STATION_MS), "micro_solvable")
        .otherwise("structured_final")
    )


def exact_ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys with n, p50 (median), p95 (element min(n - 1, int(0.95 n)) in ascending order) and max, exactly."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v"))
    placed = counted.withColumn("_to", upto).withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
    at = lambda i: F.max(F.when((F.col("_to") - F.col("_c") <= i) & (i < F.col("_to")), F.col("_v")))
    n = F.col("n")
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return placed.groupBy(*keys, "n").agg(
        ((at(low) + at(high)) / 2.0).alias("p50"), at(F.least(n - 1, F.floor(n * F.lit(0.95)))).alias("p95"), F.max("_v").alias("max")
    )


def bucket_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of every bucket in two histograms (bucket, count) and their difference, over the fixed list of buckets."""
    dim = left.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    a, b = left.select("bucket", F.col("count").alias("a")), right.select("bucket", F.col("count").alias("b"))
    both = a.join(b, "bucket", "full_outer").join(F.broadcast(dim), "bucket", "right").na.fill(0, ["a", "b"])
    return both.withColumn("diff", F.col("b") - F.col("a"))


def with_family(rows: DataFrame, families: dict[str, str], column: str, default: str = "other") -> DataFrame:
    """Rows with the family of a constraint, by a small fixed map."""
    mapping = F.create_map(*(F.lit(x) for kv in sorted(families.items()) for x in kv))
    return rows.withColumn("family", F.coalesce(mapping[F.col(column)], F.lit(default)))


def decision(failures: DataFrame, min_fails: int = MIN_FAILS) -> DataFrame:
    """Verdict from failures by family (family, n): too few failures to conclude, a family that makes half of them
    (retrieval before compression), else that the line is healthy."""
    part = lambda name: F.coalesce(F.sum(F.when(F.col("family") == name, F.col("n"))), F.lit(0)).alias(name)
    total = failures.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), part("retrieval"), part("compression"))
    half = lambda c: (F.col(c) * 2 >= F.col("total")) & (F.col(c) > 0)
    verdict = F.when(F.col("total") < min_fails, "UNDERPOWERED").when(half("retrieval"), "PHASE_4").when(half("compression"), "PHASE_5").otherwise("LINE_HEALTHY")
    return total.withColumn("verdict", verdict)


def latest_n(samples: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Statistics of the last n samples of each key."""
    recent = samples.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, order).alias("latest"))


def trailing(samples: DataFrame, now: str, seconds: int) -> DataFrame:
    """Samples of the last ``seconds`` before the clock."""
    return samples.where((F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECOND")) & (F.col("ts") <= F.lit(now).cast("timestamp_ntz")))


def latest_signals(signals: DataFrame, key: str, node: str, ts: str, value: str, now: str, ttl_s: int) -> DataFrame:
    """key, node and value of each node's latest signal, if it is not older than the time to live."""
    last = signals.groupBy(key, node).agg(F.max(F.struct(ts, value)).alias("_last"))
    age = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col(f"_last.{ts}").cast("timestamp").cast("double")
    return last.where(age <= ttl_s).select(key, node, F.col(f"_last.{value}").alias(value))


def trimmed_median(values: DataFrame, key: str, value: str, z: float) -> DataFrame:
    """Median of each key's values within z sample deviations of its median, of all of them if none is.

    The statistics are aggregates joined back; exact percentiles keep the counts of a key's different values.
    """
    stats = values.groupBy(key).agg(F.percentile(value, 0.5).alias("_m"), F.stddev_samp(value).alias("_s"))
    near = F.col("_s").isNull() | (F.col("_s") == 0) | (F.abs(F.col(value) - F.col("_m")) <= z * F.col("_s"))
    out = values.join(stats, key).groupBy(key).agg(F.percentile(F.when(near, F.col(value)), 0.5).alias("_near"), F.count_if(near).alias("_n"), F.percentile(value, 0.5).alias("_all"), F.count(value).alias("_rows"))
    return out.select(key, F.coalesce("_near", "_all").alias("median"), F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_rows")).alias("n"))


def before_after(rows: DataFrame, key: str, phase: str, value: str) -> DataFrame:
    """Per key the count and mean of both phases, the difference and the change in per cent (null from 0)."""
    side = lambda p: F.col(phase) == p
    out = rows.groupBy(key).agg(*(x for p in ("before", "after") for x in (F.count_if(side(p)).alias(f"n_{p}"), F.avg(F.when(side(p), F.col(value))).alias(f"mean_{p}"))))
    change = F.col("mean_after") - F.col("mean_before")
    return out.withColumn("delta", change).withColumn("percent", F.try_divide(change * 100, F.col("mean_before")))


def escalation(levels: DataFrame, thresholds: list[tuple[str, float]], value: str) -> DataFrame:
    """The highest level whose threshold the value reaches; thresholds ascend."""
    out = F.lit(None).cast("string")
    for name, at in thresholds:
        out = F.when(F.col(value) >= at, name).otherwise(out)
    return levels.withColumn("level", out)


def queue_depth(jobs: DataFrame) -> DataFrame:
    """Jobs by status with the oldest pending time, 0 if none is pending."""
    oldest = F.coalesce(F.min(F.when(F.col("status") == "pending", F.col("created"))), F.lit(0))
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "failed")), oldest.alias("oldest_pending"))


def positional_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str], limit: int = 10) -> DataFrame:
    """The first positions at which two replays differ, with the names of the fields that do."""
    a, b = left.select(key, F.struct(*fields).alias("_a")), right.select(key, F.struct(*fields).alias("_b"))
    names = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in fields)))
    return a.join(b, key, "full_outer").withColumn("fields", F.array_join(names, ",")).where("fields <> ''").select(key, "fields").orderBy(key).limit(limit)
