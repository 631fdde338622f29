"""Importance resampling towards a target distribution, over an integer word dictionary.

Features of a text are its runs of 1 to ``N`` consecutive words (ASCII digits and letters, A-Z lower-cased, and any
non-ASCII characters), repeats counted, each hashed into one of ``BUCKETS`` buckets. A bucket's gain is the logarithm of
its share among the target's features over its share among the corpus's, a text's weight the mean gain of its features,
and Gumbel noise that depends on seed and doc_id alone makes the top scores a sample without replacement.

Features are never spelled out one by one. A run of texts in a task (some ``RUN_BYTES``) maps its distinct words to
integers; an n-gram is the pair of its first n - 1 words' number and its last word's, made distinct in turn; the bytes
of each distinct n-gram are hashed once, going on from its first words' hash, and the buckets are joined back to the
texts by number. The dictionary lives as long as its run, so its size is bounded however many words a corpus holds, and
no word, however common, meets its other occurrences anywhere else. Corpus counts are the runs' bucket counts, added
up per task and then over all tasks; only ``BUCKETS`` rows reach the driver. The texts are read twice, for the counts
and for the weights, which costs less than to store or shuffle what they hold.

The draw takes a share of the eligible texts by score. Ranks come from counts: scores are whole numbers, so the texts of
higher scores are a prefix sum over the different scores, of which a bounded range holds a bounded number (some ten
thousand), and only texts of one score are ordered among themselves.

Edge cases: null texts have no words and weigh 0; a text needs ``LEAST_WORDS`` words to be drawn; equal scores go by
doc_id, a null one last (it is hashed as the empty string); repeated rows are texts of their own, ranked one after the
other; an empty target or corpus counts no features; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import stored
from tallystone.llm.decontaminate import Words
from tallystone.llm.textbatch import slices, text_bytes
from tallystone.session import share_package

N = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RUN_BYTES = 2_000_000
#: Scores are added up in bands of so many, and the bands' sums beside them.
BAND = 256


class Features:
    """The features of a run of texts: bucket and text of every one."""

    def __init__(self, column: pa.Array, n: int = N, buckets: int = BUCKETS):
        words = Words(*text_bytes(column))
        self.words = np.diff(words.first)
        sizes = words.ends - words.starts
        # The words' bytes, one behind the other.
        inside = np.repeat(words.starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.low[inside]))])
        coded = spelled.dictionary_encode()
        number, spellings = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        grams, prefixes = number, [crc32(w) for w in spellings]
        found, texts = [np.array(prefixes, np.int64)[grams] % buckets], [words.text]
        for k in range(1, n):
            # A gram of k + 1 words begins where one of k words does whose last word has a successor in its text.
            whole = words.text[: max(0, len(number) - k)] == words.text[k:]
            pairs = pa.array(grams[: len(whole)][whole] * max(1, len(spellings)) + number[k:][whole]).dictionary_encode()
            first, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(spellings)))
            spaced = [crc32(b" ", c) for c in prefixes]
            prefixes = [crc32(spellings[b], spaced[a]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            at = pairs.indices.to_numpy(zero_copy_only=False)
            found.append(np.array(prefixes, np.int64)[at] % buckets)
            texts.append(words.text[: len(whole)][whole])
            grams = np.full(len(whole), -1, np.int64)
            grams[whole] = at
        self.buckets, self.texts = np.concatenate(found), np.concatenate(texts)


def _count_batches(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for whole in batches:
        for batch in slices(whole, "text", RUN_BYTES):
            counts += np.bincount(Features(batch.column("text"), n, buckets).buckets, minlength=buckets)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    share_package(rows.sparkSession)
    partial = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _count_batches(b, n, buckets), "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's share in the target over its share in the corpus, as a thousandfold logarithm rounded down; one is added to each count."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weight_batches(batches: Iterator[pa.RecordBatch], shared, n: int) -> Iterator[pa.RecordBatch]:
    gain = shared.value
    for whole in batches:
        for batch in slices(whole, "text", RUN_BYTES):
            found = Features(batch.column("text"), n, len(gain))
            counts, sums = np.bincount(found.texts, minlength=batch.num_rows), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, found.texts, gain[found.buckets])
            made = [found.words, counts, sums // np.maximum(1, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in made)], names=["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain, 0 without features) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _weight_batches(b, shared, n), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel variable, rounded down, from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_rank(rows: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """``rows`` (doc_id, score) with ``rank``: from 1 by falling score for the best ``percent`` per cent of the eligible, null for others."""
    marked = rows.withColumn("_eligible", eligible).withColumn("_band", F.floor(F.col("score") / BAND))
    counts = marked.where("_eligible").groupBy("_band", "score").agg(F.count(F.lit(1)).alias("_n"))
    # Bands are few: the span of scores over BAND.
    bands = counts.groupBy("_band").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_band")).collect()
    drawn = sum(r["_n"] for r in bands) * percent // 100
    higher, above = {}, 0
    for r in bands:
        higher[r["_band"]] = above
        above += r["_n"]
    if not drawn:
        return marked.withColumn("rank", F.lit(None).cast("long")).drop("_eligible", "_band")
    offset = F.create_map(*(F.lit(x) for pair in higher.items() for x in pair))[F.col("_band")]
    within = F.sum("_n").over(W.partitionBy("_band").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))
    prefix = counts.withColumn("_above", offset + F.coalesce(within, F.lit(0))).where(F.col("_above") < drawn).select("score", "_above")
    # One row a score that reaches the draw, whatever the number of texts.
    first = F.when(F.col("_eligible"), F.col("_above"))
    place = F.row_number().over(W.partitionBy("score", "_eligible").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = marked.join(prefix, "score", "left").withColumn("rank", first + place)
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_eligible", "_band", "_above")


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``, drawn to resemble ``target``."""
    rows = stored(weights(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return with_rank(rows, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
