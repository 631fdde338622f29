"""Evidence fusion: streams are scored, set against each other, arbitrated and tested for sensitivity.

A stream has stream_id (unique; its order is the input order), type, subject, source_tier, claim (positive, negative
or neutral), confidence, severity_impact, ts, half_life (hours; null means that decay is not declared),
provenance_hash and signature_valid (true, false, or null for unsigned). The clock is a parameter.

Counts and best-of choices are aggregates that combine before the shuffle, joined back by their keys; a subject, hash
or type with very many streams never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.scalars import joined, micros, stable_id

#: Fixed values of the scoring policy.
TIER_WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.6, 5: 0.3}
W_IMPACT, W_FRESHNESS, W_RELIABILITY, W_CORROBORATION = 0.35, 0.25, 0.25, 0.15
UNSIGNED_FACTOR = 0.5
MIN_CONFIDENCE = 0.5
TIER_GAP, SCORE_GAP, DEAD_BAND = 2, 0.15, 0.05
FUTURE_SKEW_S, STALE_DAYS, DUPLICATE_WINDOW_S, FLOOD_LIMIT = 60, 365, 3600, 10
VARIATION = 0.5


def age_seconds(now: str) -> Column:
    return (micros(F.lit(now).cast("timestamp")) - micros(F.col("ts"))) / 1e6


def split_future(streams: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(streams to score, streams rejected for being more than the allowed skew ahead of the clock)."""
    ahead = -age_seconds(now) > FUTURE_SKEW_S
    return streams.where(~ahead), streams.where(ahead)


def freshness(now: str, factor: Column | float = 1.0) -> Column:
    """Half-life decay of the age; 1 for undeclared or non-positive half-lives."""
    life = F.col("half_life") * factor
    hours = F.greatest(age_seconds(now), F.lit(0.0)) / 3600
    return F.when(F.col("half_life").isNull() | (F.col("half_life") <= 0), 1.0).otherwise(F.pow(F.lit(0.5), hours / life))


def corroboration(streams: DataFrame) -> DataFrame:
    """``streams`` with the number of other streams that make the same non-neutral claim on the same subject."""
    same = streams.where("claim <> 'neutral'").groupBy(F.col("subject").alias("_s"), F.col("claim").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return streams.join(same, (F.col("subject") == F.col("_s")) & (F.col("claim") == F.col("_c")), "left").withColumn(
        "corroboration", F.coalesce(F.col("_n") - 1, F.lit(0).cast("long"))
    ).drop("_s", "_c", "_n")


def with_authority(streams: DataFrame) -> DataFrame:
    """``streams`` with the weight of their tier, halved unless the signature is valid; the tier table is a literal map."""
    weights = F.create_map(*(F.lit(x) for kv in sorted(TIER_WEIGHTS.items()) for x in kv))
    signed = F.when(F.col("signature_valid").eqNullSafe(True), 1.0).otherwise(UNSIGNED_FACTOR)
    return streams.withColumn("authority", weights[F.col("source_tier")] * signed)


def composite() -> Column:
    backed = F.least(F.col("corroboration"), F.lit(10)) / 10
    mean = W_IMPACT * F.col("severity_impact") + W_FRESHNESS * F.col("freshness") + W_RELIABILITY * F.col("confidence") + W_CORROBORATION * backed
    return F.col("authority") * mean


def repeated_hashes(streams: DataFrame) -> DataFrame:
    """provenance_hash values of which two streams that follow each other in time lie within the window.

    Times are first reduced to distinct (hash, window cell) minima and maxima, so only the cells' edges are compared:
    two streams in one cell lie within the window by themselves.
    """
    cell = F.floor(micros(F.col("ts")) / (DUPLICATE_WINDOW_S * 1_000_000))
    cells = streams.where("provenance_hash IS NOT NULL").groupBy("provenance_hash", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    before = F.lag("last").over(W.partitionBy("provenance_hash").orderBy("cell"))
    near = (F.col("n") > 1) | (micros(F.col("first")) - micros(before) <= DUPLICATE_WINDOW_S * 1_000_000)
    return cells.withColumn("near", near).where("near").select("provenance_hash").distinct()


def flooded_types(streams: DataFrame) -> DataFrame:
    return streams.groupBy("type").agg(F.count(F.lit(1)).alias("n_streams")).where(F.col("n_streams") > FLOOD_LIMIT)


def scored(streams: DataFrame, now: str, factor: Column | float = 1.0) -> DataFrame:
    """Streams not rejected, with authority, freshness, corroboration and composite."""
    accepted, _ = split_future(streams, now)
    return with_authority(corroboration(accepted)).withColumn("freshness", freshness(now, factor)).withColumn("composite", composite())


def flagged(streams: DataFrame, now: str) -> DataFrame:
    """Scored streams with their sorted distinct flags as text."""
    rows = scored(streams, now)
    repeated = repeated_hashes(rows).select(F.col("provenance_hash").alias("_h"), F.lit(True).alias("_repeated"))
    floods = flooded_types(rows).select(F.col("type").alias("_t"), F.lit(True).alias("_flooded"))
    rows = rows.join(repeated, F.col("provenance_hash") == F.col("_h"), "left").join(floods, F.col("type") == F.col("_t"), "left")
    flags = F.array(
        F.when(F.col("half_life").isNull(), "decay_missing"),
        F.concat(F.lit("claim_"), F.col("claim")),
        F.when(F.col("signature_valid").isNull(), "unsigned").when(F.col("signature_valid"), "signature_valid").otherwise("signature_invalid"),
        F.when(age_seconds(now) > STALE_DAYS * 86400, "stale"),
        F.when(F.col("_repeated"), "duplicate_provenance"),
        F.when(F.col("_flooded"), "type_flooding"),
    )
    return rows.withColumn("flags", joined(flags)).drop("_h", "_repeated", "_t", "_flooded")


def band(score: Column) -> Column:
    return F.when(score < MIN_CONFIDENCE, "unreliable").when(score >= 0.85, "high").when(score >= 0.65, "moderate").otherwise("low")


def ranked(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n streams of largest composite, first input first."""
    return rows.orderBy(F.desc("composite"), "stream_id").limit(n).withColumn("band", band(F.col("composite")))


def acceptance(rows: DataFrame) -> DataFrame:
    """Streams at or above the confidence threshold, and below it, for each type."""
    ok = F.col("composite") >= MIN_CONFIDENCE
    return rows.groupBy("type").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def conclusions(rows: DataFrame, *keys: str) -> DataFrame:
    """Subjects that an accepted stream supports or opposes, with the first such stream."""
    return (
        rows.where((F.col("composite") >= MIN_CONFIDENCE) & (F.col("claim") != "neutral"))
        .groupBy(*keys, "subject", F.when(F.col("claim") == "positive", "supported").otherwise("opposed").alias("polarity"))
        .agg(F.min("stream_id").alias("first_stream"))
    )


def conflicts(rows: DataFrame) -> DataFrame:
    """For each type the best positive and the best negative stream: structs p and n."""
    best = F.max_by(
        F.struct("stream_id", "source_tier", "composite", "ts", "corroboration"), F.struct(F.col("composite"), (-F.col("stream_id")).alias("first"))
    )
    sides = rows.where("claim <> 'neutral'").groupBy("type", "claim").agg(best.alias("best"))
    pos = sides.where("claim = 'positive'").select("type", F.col("best").alias("p"))
    neg = sides.where("claim = 'negative'").select("type", F.col("best").alias("n"))
    return pos.join(neg, "type")


def arbitrated(pairs: DataFrame) -> DataFrame:
    """Which side of a conflict prevails, and by which rule of the ladder."""
    p, n = F.col("p"), F.col("n")
    gap = p["composite"] - n["composite"]
    tiers = F.abs(p["source_tier"] - n["source_tier"])
    rule = (
        F.when(tiers >= TIER_GAP, "authority")
        .when(F.abs(gap) >= SCORE_GAP, "score")
        .when(F.abs(gap) < DEAD_BAND, "dispute")
        .when(p["ts"] != n["ts"], "freshness")
        .when(p["corroboration"] != n["corroboration"], "corroboration")
        .otherwise("dispute")
    )
    first = (
        F.when(F.col("rule") == "authority", p["source_tier"] < n["source_tier"])
        .when(F.col("rule") == "score", gap > 0)
        .when(F.col("rule") == "freshness", p["ts"] > n["ts"])
        .when(F.col("rule") == "corroboration", p["corroboration"] > n["corroboration"])
    )
    out = pairs.withColumn("rule", rule).withColumn("first", first)
    return out.select(
        "type",
        stable_id(p["stream_id"], n["stream_id"], length=16).alias("conflict_id"),
        "rule",
        F.when(F.col("first"), p["stream_id"]).when(~F.col("first"), n["stream_id"]).alias("winner"),
        F.when(F.col("first"), n["stream_id"]).when(~F.col("first"), p["stream_id"]).alias("loser"),
        F.abs(gap).alias("gap"),
    )


def sensitivity(streams: DataFrame, now: str, variation: float = VARIATION) -> DataFrame:
    """Conclusions that appear or vanish when all half-lives are scaled down or up together."""
    base = scored(streams, now)
    factors = F.explode(F.array(F.lit(1 - variation), F.lit(1 + variation))).alias("factor")
    varied = base.select("*", factors).withColumn("freshness", freshness(now, F.col("factor"))).withColumn("composite", composite())
    after = conclusions(varied, "factor").drop("first_stream")
    before = conclusions(base).drop("first_stream").select("*", factors)
    keys = ["factor", "subject", "polarity"]
    gained = after.join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    return gained.unionByName(before.join(after, keys, "left_anti").withColumn("change", F.lit("removed")))


def sensitivity_single(streams: DataFrame, now: str, variation: float = VARIATION) -> DataFrame:
    """Streams with a finite half-life whose own variation moves them over the threshold. Only the row itself changes."""
    base = scored(streams, now).where("half_life > 0")
    each = base.select("*", F.explode(F.array(F.lit(1 - variation), F.lit(1 + variation))).alias("factor")).withColumn("was", F.col("composite"))
    moved = each.withColumn("freshness", freshness(now, F.col("factor"))).withColumn("composite", composite())
    was, now_in = F.col("was") >= MIN_CONFIDENCE, F.col("composite") >= MIN_CONFIDENCE
    return moved.where(was != now_in).select("stream_id", "factor", F.when(now_in, "added").otherwise("removed").alias("change"))


def version_diff(old: DataFrame, new: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Added, removed and retained streams of two versions, with what changed."""
    a = old.select("stream_id", F.struct("confidence", "claim", "source_tier").alias("o"))
    b = new.select("stream_id", F.struct("confidence", "claim", "source_tier").alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("retained")
    changed = F.array(
        F.when(F.abs(F.col("o.confidence") - F.col("n.confidence")) > eps, "confidence"),
        F.when(F.col("o.claim") != F.col("n.claim"), "claim"),
        F.when(F.col("o.source_tier") != F.col("n.source_tier"), "source_tier"),
    )
    return a.join(b, "stream_id", "full_outer").select("stream_id", state.alias("state"), joined(changed).alias("changed"))


def synthesis(old: DataFrame, new: DataFrame) -> DataFrame:
    """Conclusions that are stable, new or dropped from one version to the next."""
    a, b = (conclusions(x).select("subject", "polarity") for x in (old, new))
    return (
        a.intersect(b).withColumn("state", F.lit("stable"))
        .unionByName(b.subtract(a).withColumn("state", F.lit("new")))
        .unionByName(a.subtract(b).withColumn("state", F.lit("dropped")))
    )


def synthesis_summary(rows: DataFrame) -> DataFrame:
    """One row on the streams of the newest version: how many are accepted, and the highest (least) and lowest tier scored."""
    return rows.agg(F.count_if(F.col("composite") >= MIN_CONFIDENCE).alias("streams_used"), F.min("source_tier").alias("highest_tier"), F.max("source_tier").alias("lowest_tier"))


def feedback_streams(feedback: DataFrame) -> DataFrame:
    """Reviewers' feedback (case_id, author, verdict, comment, ts) as streams with derived id and hash."""
    body = F.coalesce(F.col("comment"), F.lit(""))
    polarity = F.when(F.col("verdict") == "accept", "positive").when(F.col("verdict") == "reject", "negative").otherwise("neutral")
    return feedback.select(
        stable_id(F.col("case_id"), F.col("author"), body, length=16).alias("stream_id"),
        F.lit("feedback").alias("type"),
        F.col("case_id").alias("subject"),
        polarity.alias("claim"),
        F.sha2(body, 256).alias("provenance_hash"),
        "ts",
    )
