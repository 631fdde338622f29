"""Benchmark decontamination by winnowing.

Words are the maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and any non-ASCII characters. A window is
``window`` consecutive words of a benchmark item; an item with fewer words is one window of all its words. Documents
and items keep, in every run of ``window - gram + 1`` word grams, the grams with the smallest hash, so any shared
span of at least ``window`` words shares a kept gram. Kept grams are joined by hash, compared as text and extended
word by word; an extension of a whole window or more marks its document words as hit.

Edge cases: a null or empty text has no words and is never contaminated; an item without words has no window; rows
with a null item_id mark words but are not listed; repeated document rows each give a row; columns other than those
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import stored
from tallystone.llm.columns import numbered, restored, without
from tallystone.llm.textbatch import U64, slices, span_hashes, splitmix, text_bytes
from tallystone.session import share_package

WINDOW = 13
GRAM = 5
#: The Bloom filter that spares grams from the shuffle has at most so many bits (8 MB); a fuller one only spares fewer.
FILTER_BITS = 1 << 26
#: Benchmark fingerprints are broadcast up to so many rows; beyond it both sides are shuffled, the items salted.
BROADCAST_ROWS = 100_000
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = True
_IN_WORD[128:] = True

_GRAM_TYPE = "array<struct<fp:long,len:int,at:int,mid:string,before:array<string>,after:array<string>>>"
_GRAM_ARROW = pa.list_(
    pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("at", pa.int32()), ("mid", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
)


class Words:
    """The words of a run of texts: byte bounds, the text each belongs to, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[data]
        inside = _IN_WORD[self.low]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            before[edges] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.hashes = span_hashes(self.low, self.starts, self.ends)
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the n words from each word on, and whether they lie in one text."""
        size = len(self.hashes) - n + 1
        if size <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        out = np.full(size, n, U64)
        for j in range(n):
            out = out * U64(0xD6E8FEB86659FD93) + self.hashes[j : j + size]
        return splitmix(out), self.text[:size] == self.text[n - 1 :]

    def winnowed(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the grams that are least in some run of window - gram + 1 grams of one text."""
        hashes, _ = self.grams(gram)
        span = window - gram + 1
        runs = len(self.hashes) - window + 1
        if runs <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        least = hashes[:runs].copy()
        for j in range(1, span):
            np.minimum(least, hashes[j : j + runs], out=least)
        least[self.text[:runs] != self.text[window - 1 :]] = 0
        most = np.zeros(len(hashes), U64)
        for j in range(span):
            np.maximum(most[j : j + runs], least, out=most[j : j + runs])
        kept = np.flatnonzero((most == hashes) & (most > 0))
        return kept, hashes[kept]

    def words(self, start: int, end: int) -> list[str]:
        return [self.low[self.starts[i] : self.ends[i]].tobytes().decode() for i in range(start, end)]

    def context(self, at: int, n: int, reach: int, fp: int) -> tuple[int, dict]:
        """The text, and the gram with up to ``reach`` words to either side, nearest first."""
        text = int(self.text[at])
        low, high = int(self.first[text]), int(self.first[text + 1])
        return text, {
            "fp": int(np.uint64(fp).astype(np.int64)),
            "len": n,
            "at": at - low,
            "mid": " ".join(self.words(at, at + n)),
            "before": self.words(max(low, at - reach), at)[::-1],
            "after": self.words(at + n, min(high, at + n + reach)),
        }


def _bloom_slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> U64(32)) & mask).astype(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(*text_bytes(batch.column("text")))
            counts = np.diff(words.first)
            rows: list[tuple[int, dict]] = []
            kept, hashes = words.winnowed(gram, window)
            rows += [words.context(int(p), gram, window - gram, h) for p, h in zip(kept, hashes, strict=True)]
            for i in np.flatnonzero((counts > 0) & (counts < window)):
                n = int(counts[i])
                value = splitmix(_fold(words.hashes[words.first[i] : words.first[i + 1]]))
                rows.append(words.context(int(words.first[i]), n, 0, value))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array([t for t, _ in rows], pa.int64())),
                    *(pa.array([g[k] for _, g in rows], _GRAM_ARROW.value_type.field(k).type) for k in ("fp", "len", "mid", "before", "after")),
                    pa.array([int(counts[t]) < window for t, _ in rows], pa.bool_()),
                ],
                names=["item_id", "fp", "len", "mid", "before", "after", "short"],
            )


def _fold(hashes: np.ndarray) -> np.ndarray:
    out = np.full(1, len(hashes), U64)
    for h in hashes:
        out = out * U64(0xD6E8FEB86659FD93) + h
    return out


def item_fingerprints(items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Kept grams of every benchmark item, with the words around them: item_id, fp, len, mid, before, after, short."""
    share_package(items.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _item_batches(batches, gram, window),
        f"item_id {kind}, fp long, len int, mid string, before array<string>, after array<string>, short boolean",
    )


def _filter_part(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The 64-bit words of a Bloom filter that are not zero, for the prints of one task."""
    for batch in batches:
        slots = np.concatenate(_bloom_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64), bits))
        places, at = np.unique(slots >> 6, return_inverse=True)
        values = np.zeros(len(places), np.int64)
        np.bitwise_or.at(values, at, np.int64(1) << (slots & 63))
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values)], names=["place", "value"])


def bloom_filter(prints: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the fp column; its size follows ``count`` but never passes FILTER_BITS, a million words of 64 bits."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 32 * count):
        bits *= 2
    parts = prints.select("fp").mapInArrow(lambda b: _filter_part(b, bits), "place long, value long").groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[parts.column("place").to_numpy()] = parts.column("value").to_numpy()
    return out.view(np.uint8), bits


def _document_batches(batches: Iterator[pa.RecordBatch], bloom, bits: int, short: list[int], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    table = bloom.value
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(*text_bytes(batch.column("text")))
            grams: list[list[dict]] = [[] for _ in range(batch.num_rows)]

            def add(at: np.ndarray, hashes: np.ndarray, n: int, reach: int, words=words, grams=grams) -> None:
                one, two = _bloom_slots(hashes, bits)
                found = (table[one >> 3] >> (one & 7).astype(np.uint8)) & (table[two >> 3] >> (two & 7).astype(np.uint8)) & 1
                for i in np.flatnonzero(found):
                    text, row = words.context(int(at[i]), n, reach, hashes[i])
                    grams[text].append(row)

            add(*words.winnowed(gram, window), gram, window - gram)
            for n in short:
                hashes, whole_gram = words.grams(n)
                at = np.flatnonzero(whole_gram)
                add(at, hashes[at], n, 0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(words.first).astype(np.int64)), pa.array(grams, _GRAM_ARROW)],
                names=[*keep, "n_words", "grams"],
            )


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _covered(spans: Column) -> Column:
    """How many words the union of sorted (start, end) spans holds."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, spans (word start, end), items (sorted ids), contaminated.

    ``docs`` needs doc_id and text, ``items`` item_id and text. A document is contaminated if a word is hit and the hit
    words make up a twentieth of its words or more.
    """
    spark = docs.sparkSession
    share_package(spark)
    prints = stored(item_fingerprints(items, gram, window))
    shape = prints.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("short"), F.col("len"))).alias("short")).first()
    table, bits = bloom_filter(prints, shape["n"])
    bloom, short = spark.sparkContext.broadcast(table), sorted(shape["short"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lambda b: _document_batches(b, bloom, bits, short, gram, window), f"row long, doc_id {kind}, n_words long, grams {_GRAM_TYPE}")
    rows = found.select("row", "doc_id", "n_words", F.explode_outer("grams").alias("g")).select("row", "doc_id", "n_words", "g.*")
    # Items that hold a gram in the same surroundings meet documents as one row.
    known = prints.groupBy("short", *(F.col(c).alias(f"i_{c}") for c in ("fp", "len", "mid", "before", "after"))).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    on = (F.col("fp") == F.col("i_fp")) & (F.col("len") == F.col("i_len")) & (F.col("mid") == F.col("i_mid"))
    if shape["n"] <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(known), on, "left")
    else:
        salted = known.withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt") == F.col("i_salt")), "left")
    back = F.when(F.col("short"), F.lit(0)).otherwise(_agree(F.col("before"), F.col("i_before")))
    ahead = F.when(F.col("short"), F.lit(0)).otherwise(_agree(F.col("after"), F.col("i_after")))
    spans = joined.withColumn("start", F.col("at") - back).withColumn("end", F.col("at") + F.col("len") + ahead)
    hit = F.col("short") | (F.col("end") - F.col("start") >= window)
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("ids")))))).alias("items"),
    )
    return out.withColumn("n_hit", _covered(F.col("spans"))).select(
        "doc_id", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Rows are matched by doc_id and the text's hash."""
    version = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", version.alias("version")).alias("doc_id"), "text")
    bad = contamination(keyed, items, gram, window).where("contaminated").select("doc_id.*").distinct()
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("version").alias("_bad_version"))
    kept = without(numbered(docs, "doc_id", "text"), bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_version")))
    return restored(kept, docs, "doc_id", "text")
