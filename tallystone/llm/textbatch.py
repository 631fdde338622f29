"""Vectorised views of a text column inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null reads as the empty string. Offsets start at 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = (int(off[0]), int(off[-1])) if len(column) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, off - first if len(column) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, budget: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``budget`` text bytes; a longer row stands alone."""
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + budget, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on a uint64 array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=U64)
        if n > 1 << 23:
            return table
        _powers[base] = table
    return _powers[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every data[start:end]; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * _power_table(_BASE, n), out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * _power_table(_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))
