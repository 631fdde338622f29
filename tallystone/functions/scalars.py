"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, read in the session's zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def stable_id(*parts: Column, length: int = 64) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the parts joined by ``|``; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def falsy_or(value: Column, other: Column, empty) -> Column:
    """``value`` unless it is null or equals ``empty``, else ``other``."""
    return F.coalesce(F.nullif(value, F.lit(empty)), other)


def joined(values: Column, by: str = ",") -> Column:
    """An array's elements as text, sorted and distinct."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), by)


def nearest_rank(values: Column, share: float) -> Column:
    """Element ``min(n - 1, int(share * n))`` of an array in ascending order (0-based), 0.0 if it is empty."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(share)).cast("int"))
    return F.when(n > 0, F.array_sort(values)[at].cast("double")).otherwise(F.lit(0.0))
