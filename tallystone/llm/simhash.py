"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set where more than half of the text's word shingles (XXH64, seed 42, repeats counted) have
it. Equal fingerprints are merged first. Two fingerprints link if at most ``RADIUS`` of their 64 bits differ.

Candidates: the fingerprint is cut into ``RADIUS + 2`` bands; a pair within the radius agrees on some two of them, so
each fingerprint enters six buckets of 32 agreeing bits. A bucket of more than ``BUCKET`` fingerprints is dealt again
by the same rule over the bits that are still free, into buckets of 48 and then 56 agreeing bits; of the last kind
none can hold more than 256 fingerprints. Inside a task all buckets are compared together: the bits are stored as 64
vertical planes, one long bit string each, and a shift by d lines every fingerprint up with the d-th next one.
Carry-save counters (ones, twos, more) add up the planes' differences for all these pairs at once, and a shift is
abandoned as soon as every pair is past the radius.

Components of the links give each document the smallest doc_id it reaches.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle; repeated rows each give a row; null doc_ids never name a component unless it has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import cut
from tallystone.llm.columns import numbered, restored, without
from tallystone.llm.components import least_reached, smallest_reachable
from tallystone.session import share_package

SHINGLE = 3
RADIUS = 2
BUCKET = 512
SEED = 42

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        part = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(part, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document row."""
    share_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprint_batches(b, shingle), f"doc_id {kind}, fp long")


def _masks() -> list[list[int]]:
    """For each depth the masks of the bits that a bucket's members share; those of mask i are split into 6 i to 6 i + 5."""
    levels, spread = [], [[list(range(64))]]
    for _ in range(3):
        ways = []
        for free in (f for group in spread for f in group):
            bands = [free[i * len(free) // 4 : (i + 1) * len(free) // 4] for i in range(4)]
            ways.append([sorted(bands[c] + bands[d]) for a in range(4) for b in range(a + 1, 4) for c, d in [[x for x in range(4) if x not in (a, b)]]])
        levels.append([(1 << 64) - 1 - sum(1 << bit for bit in f) for group in ways for f in group])
        spread = ways
    return levels


_MASKS = _masks()


def _bucket_keys(fps: DataFrame, depth: int) -> DataFrame:
    """fp, way and key of the six buckets into which each row (fp and, past the first depth, way) is dealt next."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _MASKS[depth]]
    step = lambda j: F.lit(j) if depth == 0 else F.col("way") * 6 + j
    mask = lambda way: F.element_at(F.array(*map(F.lit, signed)), way + 1)
    dealt = fps.select("fp", F.explode(F.array(*(step(j) for j in range(6)))).alias("way"))
    return dealt.select("fp", "way", F.xxhash64("way", F.col("fp").bitwiseAND(mask(F.col("way")))).alias("key"))


def _planes(fps: np.ndarray) -> list[int]:
    """Bit b of every fingerprint as one long bit string, for each b."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(64)]


def _set_bits(value: int, n: int) -> np.ndarray:
    raw = np.frombuffer(value.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def close_pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs with equal key, sorted by key, whose fingerprints differ in at most two bits."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    where, planes = np.arange(len(keys)), _planes(fps)
    for shift in range(1, len(keys)):
        mates = keys[where[:-shift]] == keys[where[shift:]]
        if not mates.any():
            break
        if 4 * mates.sum() < len(where):
            # The other buckets have met all their members; only those with a partner this far apart go on.
            where = where[np.isin(keys[where], keys[where[:-shift]][mates])]
            planes, mates = _planes(fps[where]), keys[where[:-shift]] == keys[where[shift:]]
        alive = int.from_bytes(np.packbits(mates, bitorder="little").tobytes(), "little")
        ones = twos = more = 0
        for number, plane in enumerate(planes, 1):
            differs = (plane ^ (plane >> shift)) & alive
            carry = ones & differs
            ones ^= differs
            more |= twos & carry
            twos ^= carry
            if number % 8 == 0:
                alive &= ~(more | (ones & twos))
                if not alive:
                    break
        if alive:
            hits = _set_bits(alive, len(where))
            left.append(where[hits])
            right.append(where[hits + shift])
    return np.concatenate(left), np.concatenate(right)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a task's rows, which come sorted by key; a bucket may reach over batches."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def compared(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        least = least_reached(len(fps), *close_pairs(keys, fps.view(np.uint64)))
        linked = np.flatnonzero(least != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[least[linked]])], names=["a", "b"])

    for batch in batches:
        keys, fps = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole:
            yield compared(keys[:whole], fps[:whole])
        held = [keys[whole:], fps[whole:]]
    if len(held[0]):
        yield compared(*held)


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join every pair of distinct fingerprints (column fp) within the radius, stars where many meet."""
    found, rest = [], fps
    for depth in range(len(_MASKS)):
        keys = _bucket_keys(rest, depth)
        sizes = keys.groupBy("key").count().where("count > 1")
        if depth + 1 < len(_MASKS):
            rest = keys.join(sizes.where(F.col("count") > bucket).select("key"), "key", "left_semi").select("fp", "way")
            sizes = sizes.where(F.col("count") <= bucket)
        some = keys.join(sizes.select("key"), "key", "left_semi")
        found.append(some.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_link_batches, "a long, b long"))
    return reduce(DataFrame.unionAll, found)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that the document reaches) for every document row."""
    rows = cut(fingerprints(docs, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), rows.count())
    roots = smallest_reachable(fingerprint_links(classes.select("fp"), bucket), classes.count())
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = rooted.join(smallest, "root").where("copies > 1 or members > 1").select(F.col("fp").alias("class_fp"), "component_id")
    joined = rows.join(named, F.col("fp") == F.col("class_fp"), "left")
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller doc_id; rows with a null doc_id stay.

    Documents are told apart by doc_id and text: of rows that repeat a doc_id only those go whose own text is a near
    copy of a document with a smaller doc_id.
    """
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("version"))).alias("doc_id"), "text")
    gone = near_duplicates(keyed, shingle, bucket).where("doc_id.doc_id <> component_id.doc_id").select("doc_id.*").distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("version").alias("_gone_version"))
    kept = without(numbered(docs, "doc_id", "text"), gone, (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_version")))
    return restored(kept, docs, "doc_id", "text")


def fingerprint_hex(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
