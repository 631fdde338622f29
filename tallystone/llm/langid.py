"""Language identification by nearest centroid.

A text becomes counts of its byte bigrams and trigrams (A-Z lower-cased, other ASCII but letters read as one space),
hashed to ``DIMENSIONS`` features, damped, weighted by inverse document frequency and normalised. Each language has up
to ``CLUSTERS`` centroids from spherical k-means; the prediction is the language of the centroid of largest cosine. A
text farther from its language's centroids than ``REJECT`` of that language's training texts is marked rejected.

Document frequencies are counted over all labelled rows, languages weighing the same. The centroids are fitted on a bounded sample of them,
``FIT_ROWS`` a language (in expectation, equal texts once), drawn by a hash of doc_id and text; each language is
clustered in a task of its own and only its centroids reach the driver, ``CLUSTERS`` times ``DIMENSIONS`` floats a
language. Whole texts are read for fitting and for predicting. Prediction uses the text alone.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows with null labels are not learned from;
with no labelled row at all every text is ``und``; repeated rows each give a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.textbatch import slices, text_bytes
from tallystone.session import share_package

DIMENSIONS = 4096
CLUSTERS = 3
FIT_ROWS = 400
REJECT = 0.002
UNDETERMINED = "und"

_READ = np.full(256, 32, np.uint32)
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def counts_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature counts of each text, as float32 rows."""
    read = _READ[data]
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    if len(read) < 2:
        return out
    pairs = (read[:-1] << np.uint32(8)) | read[1:]
    triples = (pairs[:-1] << np.uint32(8)) | read[2:]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    two = (pairs * np.uint32(2654435761)) >> shift
    three = ((triples ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= 2:
            out[i] = np.bincount(two[a : b - 1], minlength=DIMENSIONS)
        if b - a >= 3:
            out[i] += np.bincount(three[a : b - 2], minlength=DIMENSIONS)
    return out


def weighted_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts, weighted and of length one."""
    weighted = np.log1p(counts) * idf
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    owner: np.ndarray
    reject_below: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine, of the nearest centroid."""
        cosines = weighted_vectors(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return self.owner[best], cosines[np.arange(len(best)), best]


def _spherical_kmeans(vectors: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids; the first is nearest the mean, each next one farthest from those chosen."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(15):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == i].sum(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    # Clusters of a few odd texts would attract odd texts of every language.
    sizes = np.bincount((vectors @ centroids.T).argmax(axis=1), minlength=len(centroids))
    keep = sizes >= min(len(vectors), max(2, len(vectors) // 20))
    return centroids[keep] if keep.any() else centroids[[int(sizes.argmax())]]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang with the text's features, those that occur, as positions and counts."""
    for whole in batches:
        for batch in slices(whole, "text", 500_000):
            counts = counts_matrix(*text_bytes(batch.column("text")))
            at = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([row[a] for row, a in zip(counts, at, strict=True)], pa.list_(pa.float32()))],
                names=["lang", "at", "n"],
            )


def _document_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature the weight of a task's texts that hold it."""
    held = np.zeros(DIMENSIONS)
    for whole in batches:
        for batch in slices(whole, "text", 1_000_000):
            held += batch.column("weight").to_numpy() @ (counts_matrix(*text_bytes(batch.column("text"))) > 0)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["feature", "share"])


def _inverse_frequencies(texts: DataFrame, totals: dict[str, int]) -> np.ndarray:
    """Of all texts, each language weighing the same however many it has."""
    n = sum(totals.values())
    weight = F.create_map(*(F.lit(x) for lang, k in sorted(totals.items()) for x in (lang, 1.0 / (k * len(totals)))))
    rows = texts.select("text", weight[F.col("lang")].alias("weight")).mapInArrow(_document_shares, "feature int, share double").groupBy("feature").agg(F.sum("share").alias("share")).collect()  # DIMENSIONS rows
    held = np.zeros(DIMENSIONS)
    for r in rows:
        held[r["feature"]] = n * r["share"]
    return (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)


def _clustered(sample: pa.Table, idf: np.ndarray) -> pa.Table:
    """Centroids of one language's sample, with the cosine below which a text is too far."""
    counts = np.zeros((sample.num_rows, DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(zip(sample.column("at").to_pylist(), sample.column("n").to_pylist(), strict=True)):
        counts[i, at] = n
    counts = counts[np.lexsort((counts @ np.arange(DIMENSIONS), counts.sum(axis=1)))]  # the same model whatever the rows' order
    vectors = weighted_vectors(counts, idf)
    centroids = _spherical_kmeans(vectors, CLUSTERS).astype(np.float32)
    reject = float(np.quantile((vectors @ centroids.T).max(axis=1), REJECT))
    lang = sample.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(centroids), pa.string()), pa.array(list(centroids), pa.list_(pa.float32())), pa.array([reject] * len(centroids), pa.float64())], names=["lang", "centroid", "reject"])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from doc_id, text and lang; None if no row has both text with a letter and label."""
    share_package(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    totals = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not totals:
        return None
    idf = _inverse_frequencies(usable, totals)
    grain = 1 << 30
    share = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, int(min(1.0, fit_rows / n) * grain))))
    drawn = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"), F.xxhash64("text").alias("version")).where(F.pmod("draw", F.lit(grain)) < share[F.col("lang")])
    sample = drawn.dropDuplicates(["lang", "version"]).select("lang", "text").mapInArrow(_sparse, "lang string, at array<int>, n array<float>")
    rows = sorted(sample.groupBy("lang").applyInArrow(lambda t: _clustered(t, idf), "lang string, centroid array<float>, reject double").collect(), key=lambda r: (r["lang"], r["centroid"]))
    names = sorted({r["lang"] for r in rows})
    if not rows:  # the draw may leave nothing of very few rows
        return fit(labelled, 10 * fit_rows)
    centroids = np.array([r["centroid"] for r in rows], np.float32)
    return Model(idf, centroids, names, np.array([names.index(r["lang"]) for r in rows]), np.array([next(r["reject"] for r in rows if r["lang"] == n) for n in names]))


def _predict_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for whole in batches:
        for batch in slices(whole, "text", 1_000_000):
            letters = np.array([_has_letter(t.as_py()) for t in batch.column("text")], bool)
            if model is None:
                names, score, far = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            else:
                language, cosine = model.predict(counts_matrix(*text_bytes(batch.column("text"))))
                names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(language, letters, strict=True)]
                score = np.where(letters, np.clip(cosine, 0, 1), 0).astype(np.float64)
                far = ~letters | (cosine < model.reject_below[language])
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(far)], names=[*keep, "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The ``keep`` columns plus lang_pred, score and rejected for every row."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS floats a centroid, CLUSTERS centroids a language
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: _predict_batches(b, shared), f"{kinds}, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds
