"""Exact order statistics of groups of any size, by counting and narrowing instead of sorting.

A wanted rank is looked for in the range of its group's values: the range is cut into equal bins, the values are
counted (which combines before the shuffle), and the bin that holds the rank, from its least to its greatest value,
is the next range. It ends when a range is one value. A task holds counts of bins, never a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.functions.lineage import cut

BINS = 4_096
#: Powers of two that a range spans at least if it is cut by powers.
WIDE = 16.0
#: Ranges are sent to all tasks up to so many rows; beyond it both sides are shuffled, a group's values in so many parts.
BROADCAST_ROWS, SALTS = 100_000, 32


def _power(v: Column) -> Column:
    """The power of two of a number, from 26 up for positive ones and from -26 down for negative ones; 0 for 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.when(v == 0, 1.0).otherwise(F.abs(v))) + 1100.0))


def ranked(values: DataFrame, key: str, value: str, wanted: dict[str, Column], bins: int = BINS) -> DataFrame:
    """key, n and a column for each wanted rank: the value at that place, from 0, of the group's values in ascending order.

    A wanted rank is a column of ``n``, the group's number of values that are neither null nor NaN; other groups have no
    row. Values are taken as doubles.
    """
    rows = values.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    totals = cut(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    names = [*wanted]
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), wanted[c].cast("long").alias("rank")) for i, c in enumerate(names))))
    asked = totals.select("_k", "_low", "_high", ranks.alias("_r")).select("_k", "_low", "_high", F.col("_r.i").alias("_i"), F.col("_r.rank").alias("_rank"))
    done, open_ = asked.where("_low = _high"), cut(asked.where("_low < _high"))
    while not open_.isEmpty():
        ranges = open_.select(F.col("_k").alias("_key"), "_low", "_high").distinct()
        # Ranges over many powers of two are cut by these first (the logarithm is monotone), then evenly.
        low, high, v = F.col("_low"), F.col("_high"), F.col("_v")
        wide = _power(high) - _power(low) > WIDE
        share = F.when(wide, (_power(v) - _power(low)) / (_power(high) - _power(low))).otherwise((v - low) / (high - low))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        same, inside = F.col("_k").eqNullSafe(F.col("_key")), (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        if ranges.count() <= BROADCAST_ROWS:
            met = rows.join(F.broadcast(ranges), same & inside)
        else:
            salted = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_part") == F.col("_salt")) & inside)
        counted = met.groupBy("_k", "_low", "_high", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        # At most ``bins`` rows a range.
        before = F.coalesce(F.sum("_c").over(W.partitionBy("_k", "_low", "_high").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("_before", before)
        named = placed.select(F.col("_k").alias("_key"), F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_before", "_c", "_from", "_to")
        on = F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_low") == F.col("_l")) & (F.col("_high") == F.col("_h"))
        narrowed = open_.join(named, on).where("_rank >= _before AND _rank < _before + _c")
        narrowed = cut(narrowed.select("_k", F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_i", (F.col("_rank") - F.col("_before")).alias("_rank")))
        done = done.unionByName(narrowed.where("_low = _high"))
        open_ = narrowed.where("_low < _high")
    found = done.groupBy(F.col("_k").alias("_key")).agg(*(F.max(F.when(F.col("_i") == i, F.col("_low"))).alias(c) for i, c in enumerate(names)))
    return totals.join(found, F.col("_k").eqNullSafe(F.col("_key"))).select(F.col("_k").alias(key), "n", *names)


def quantiles(values: DataFrame, key: str, value: str, at: Sequence[float] = (0.95,)) -> DataFrame:
    """key, n, p50 (median), a column p<hundredths> for each of ``at`` (the element min(n - 1, int(q n)) in ascending order) and max."""
    n = F.col("n")
    wanted = {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2), "max": n - 1} | {f"p{round(100 * q)}": F.least(n - 1, F.floor(n * F.lit(q))) for q in at}
    found = ranked(values, key, value, wanted)
    return found.select(key, "n", ((F.col("_a") + F.col("_b")) / 2.0).alias("p50"), *(f"p{round(100 * q)}" for q in at), "max")


def near_median(values: DataFrame, key: str, value: str, z: float) -> DataFrame:
    """key, median and n of each group's values within ``z`` sample deviations of its median, of all of them if none is."""
    n = F.col("n")
    middle = lambda rows: ranked(rows, key, value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)}).select(F.col(key).alias("_key"), "n", ((F.col("_a") + F.col("_b")) / 2.0).alias("_m"))
    rows = values.select(F.col(key), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    spread = rows.groupBy(F.col(key).alias("_k2")).agg(F.stddev_samp(value).alias("_s"))
    stats = cut(middle(rows).join(spread, F.col("_key").eqNullSafe(F.col("_k2"))).select("_key", "n", "_m", "_s"))
    near = F.col("_s").isNull() | (F.col("_s") == 0) | (F.abs(F.col(value) - F.col("_m")) <= z * F.col("_s"))
    joined = rows.join(F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats, F.col(key).eqNullSafe(F.col("_key")))
    inner = middle(joined.where(near).select(key, value)).withColumnsRenamed({"_key": "_k3", "n": "_n", "_m": "_near"})
    out = stats.join(inner, F.col("_key").eqNullSafe(F.col("_k3")), "left")
    return out.select(F.col("_key").alias(key), F.coalesce("_near", "_m").alias("median"), F.coalesce("_n", "n").alias("n"))
