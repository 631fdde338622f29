"""Numeric forensics of texts and bytes. Byte counts are taken per Arrow batch; only numbers leave a task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import share_package


def page_confidence(words: DataFrame, key: str) -> DataFrame:
    """Length-weighted mean confidence of a page's words (text, confidence), and whether it is bimodal."""
    w = F.greatest(F.length("text"), F.lit(1))
    g = words.groupBy(key).agg((F.sum(w * F.col("confidence")) / F.sum(w)).alias("confidence"), (F.count_if(F.col("confidence") > 90) / F.count(F.lit(1))).alias("high"), (F.count_if(F.col("confidence") < 30) / F.count(F.lit(1))).alias("low"))
    band = F.when(F.col("confidence") >= 80, "PASS").when(F.col("confidence") >= 50, "REVIEW").otherwise("FAIL")
    return g.select(key, "confidence", band.alias("band"), ((F.col("high") > 0.4) & (F.col("low") > 0.3)).alias("bimodal"))


def byte_statistics(rows: DataFrame, key: str, content: str, block: int = 256) -> DataFrame:
    """n_bytes, entropy (bits a byte), block_variance of the entropy over whole blocks, and the pair chi-square of least bits.

    Null and empty contents have 0 everywhere.
    """

    def entropy(counts: np.ndarray) -> np.ndarray:
        p = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                b = np.frombuffer(value.as_py() or b"", np.uint8)
                counts = np.bincount(b, minlength=256)
                n = len(b) // block
                parts = np.zeros((n, 256))
                if n:
                    np.add.at(parts, (np.repeat(np.arange(n), block), b[: n * block]), 1)
                pairs = counts.reshape(128, 2)
                total = pairs.sum(axis=1)
                chi = float((((pairs[:, 0] - pairs[:, 1]) ** 2)[total > 0] / total[total > 0]).sum())
                out.append((len(b), float(entropy(counts)), float(entropy(parts).var()) if n else 0.0, chi))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=[key, "n_bytes", "entropy", "block_variance", "pair_chi2"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(content).cast("binary").alias("content")).mapInArrow(run, f"{key} {kind}, n_bytes long, entropy double, block_variance double, pair_chi2 double")


#: Lanczos' approximation of the gamma function with g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a number of 0.5 or more, to some fourteen digits."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def chi_square_p(statistic: Column, degrees: Column) -> Column:
    """The probability that a chi-square variable of so many degrees (1 to some thousands) reaches the statistic.

    The upper regularised gamma function: one less the series of the lower one below its turning point, else a continued
    fraction; both take a number of terms that follows from the degrees. Null for degrees below 1.
    """
    s, x = degrees.cast("double") / 2.0, statistic.cast("double") / 2.0
    terms = F.sequence(F.lit(1), (F.lit(80) + F.lit(12) * F.sqrt(s)).cast("int"))
    front = F.exp(-x + s * F.log(x) - log_gamma(s))
    first = F.struct((F.lit(1.0) / s).alias("term"), (F.lit(1.0) / s).alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (s + n)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    # Lentz' method: numerator and denominator of the fraction are kept as ratios of successive ones.
    tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    b0 = x + 1.0 - s
    begin = F.struct(F.lit(1e300).alias("c"), (F.lit(1.0) / tiny(b0)).alias("d"), (F.lit(1.0) / tiny(b0)).alias("h"))

    def deepen(acc: Column, n: Column) -> Column:
        a, b = -n * (n - s), b0 + 2.0 * n
        d, c = F.lit(1.0) / tiny(a * acc["d"] + b), tiny(b + a / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    lower = 1.0 - F.aggregate(terms, first, add)["sum"] * front
    upper = F.aggregate(terms, begin, deepen)["h"] * front
    return F.when(s < 0.5, None).when(x <= 0, 1.0).when(x < s + 1.0, F.greatest(lower, F.lit(0.0))).otherwise(upper)


def hidden_bits(rows: DataFrame, key: str, content: str, level: float = 0.95) -> DataFrame:
    """key, chi2, degrees, p and detected: whether values that differ in the least bit alone are unevenly often met.

    degrees are the pairs of byte values that occur. Without any p is 1. detected where p is below ``1 - level``.
    """
    share_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chi, degrees = [], []
            for value in batch.column(1):
                pairs = np.bincount(np.frombuffer(value.as_py() or b"", np.uint8), minlength=256).reshape(128, 2)
                total = pairs.sum(axis=1)
                met = total > 0
                chi.append(float(((pairs[:, 0] - pairs[:, 1])[met] ** 2 / total[met]).sum()))
                degrees.append(int(met.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chi, pa.float64()), pa.array(degrees, pa.int32())], names=[key, "chi2", "degrees"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, F.col(content).cast("binary").alias("content")).mapInArrow(run, f"{key} {kind}, chi2 double, degrees int")
    p = F.coalesce(chi_square_p(F.col("chi2"), F.col("degrees")), F.lit(1.0))
    return found.withColumn("p", p).withColumn("detected", F.col("p") < 1.0 - level)


def obstruction(rows: DataFrame) -> DataFrame:
    """Score of signals that hinder reading, 100 at most (n_scripts, n_images, encrypted, text_chars)."""
    score = F.when(F.col("encrypted"), 40).otherwise(0) + F.least(F.col("n_scripts") * 10, F.lit(30)) + F.when((F.col("n_images") > 0) & (F.col("text_chars") == 0), 35).otherwise(0) + F.when(F.col("text_chars") < 50, 10).otherwise(0)
    return rows.withColumn("score", F.least(score, F.lit(100)))
