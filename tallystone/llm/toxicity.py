"""Toxicity by compression distance.

Two zstandard dictionaries are trained on passages of labelled texts, one on ordinary and one on toxic texts. A text
is cut into overlapping windows of ``WINDOW`` words; a window's distance is its compressed length under the ordinary
dictionary less that under the toxic one. Windows of one word between pads are measured too, as in a window of several
words the price of a match hides a short one. A document's features are how many windows of each width, and which
share of them, reach each of ``THRESHOLDS``; a logistic calibration on labelled documents that no dictionary has seen
turns them into a score from 0 to 1.

Training: most of a toxic document is ordinary text, so the toxic dictionary is found in rounds. The toxic documents
are dealt into two halves; zstandard's trainer makes a dictionary of each half's passages, and the passages of a half
that the other half's dictionary shortens most, against the ordinary one, train its next, smaller dictionary. What is
shared by toxic documents and foreign to ordinary ones is left. Each round the ordinary passages that the toxic
dictionaries shorten join the ordinary dictionary, unless they hold words that toxic passages use ``RATIO`` times as
often. Such words alone stay in the toxic dictionary when the rounds are over; the trainer's other finds are ordinary
text and would be noise. The toxic dictionary lies behind the ordinary one, so both know ordinary text alike and only
what toxic texts add makes a distance; an unseen word counts as far as it shares letters with the dictionary.

The fit is bounded: at most about ``FIT_TOXIC`` and ``FIT_ORDINARY`` labelled documents, drawn by a hash of doc_id (a
doc_id counts once), are stored; of their passages at most about ``FIT_BYTES`` of each class, drawn by hash, reach the
driver. Scoring reads the text alone, whole, window by window.

Edge cases: null and empty texts have no window and get the score of a text without evidence; null labels and doc_ids
are not learned from, of several labels of a doc_id the largest counts, of several texts the least; if only one class
is labelled nothing can be told apart and every score is 0; repeated rows each give a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import stored
from tallystone.llm.textbatch import U64, slices, splitmix
from tallystone.session import share_package

FIT_TOXIC = 6_000
FIT_ORDINARY = 12_000
#: Passages that dictionaries are trained on: ordinary, toxic.
FIT_BYTES = (10_000_000, 4_000_000)
WINDOW = 6
STEP = 5
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8, 10)
ROUNDS = 7
#: Bytes of the ordinary dictionary at first, of what the rounds add to it, and of each toxic dictionary at first and at last.
BASE = 200_000
HARD = 1_000_000
TOXIC = (32_000, 16_000)
#: Passages for the ordinary dictionary at first, at most.
FIRST = 40_000
#: Ordinary passages looked through in a round, at least (if there are as many).
POOL = 100_000
FIT_THREADS = 4
#: The share of toxic passages that a round trains on, and the trainer's segment.
SHARE = 0.05
SEGMENT = 24
#: Words that toxic passages hold so many times as often as ordinary ones stay in the toxic dictionary in the end.
RATIO = 10.0
#: A passage shortened by more is a copy of one in the dictionary and tells nothing about others.
COPIED = 12
#: Words are remembered up to so many, of so many bytes, then forgotten together; no score depends on it.
CACHE = 100_000
LONGEST = 64

_PAD = b"\x01" * 12
_GRAIN = 1 << 30
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits (A-Z lower-cased) and of any other characters."""
    return (text or "").encode().translate(_LETTERS).split()


def wide_windows(counts: np.ndarray, edges: np.ndarray, size: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(text, start and length) of the windows of texts that stand one after the other.

    ``counts`` has each text's number of words; ``edges`` the places of the spaces, one before each word of a text and
    one behind its last.
    """
    n = np.where(counts > 0, 1 + np.maximum(0, counts - size + step - 1) // step, 0)
    text = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts + (counts > 0)) - counts - (counts > 0)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    start = edges[first[text] + at]
    return text, np.stack([start, edges[first[text] + np.minimum(at + size, counts[text])] - start + 1], axis=1).astype(U64)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor with the content as its dictionary."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=22,
        chain_log=6,
        hash_log=20,
        search_log=1,
        min_match=6,
        target_length=0,
        strategy=zstandard.STRATEGY_FAST,
        write_content_size=0,
        write_dict_id=0,
        write_checksum=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def lengths(by: zstandard.ZstdCompressor, data: bytes, spans: np.ndarray, threads: int = 0) -> np.ndarray:
    """Compressed length of each span (start, length) of ``data``."""
    sizes = np.zeros(len(spans), np.int64)
    for at in range(0, len(spans), 20_000):
        out = by.multi_compress_to_buffer(zstandard.BufferWithSegments(data, spans[at : at + 20_000].tobytes()), threads=threads)
        sizes[at : at + 20_000] = np.fromiter(map(len, map(out.__getitem__, range(len(out)))), np.int64, len(out))
    return sizes


def _one_by_one(pieces: list[bytes]) -> tuple[bytes, np.ndarray]:
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return b"".join(pieces), np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype(U64)


class Distances:
    """Distances of the windows of texts under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def of(self, data: bytes, spans: np.ndarray) -> np.ndarray:
        return lengths(self.ordinary, data, spans) - lengths(self.toxic, data, spans)

    def apart(self, words: list[bytes]) -> np.ndarray:
        """Distances of single words between pads."""
        return self.of(*_one_by_one([b"%b %b %b" % (_PAD, w, _PAD) for w in words]))

    def of_words(self, words: list[bytes]) -> np.ndarray:
        fresh = [w for w in {*words} if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = [*{*words}]
        self.known.update(zip(fresh, self.apart(fresh).tolist(), strict=True))
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for w in fresh:
            if len(w) > LONGEST:
                del self.known[w]
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row a text."""
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        data = b"".join(b" %b " % b" ".join(w) for w in split if w)
        text, spans = wide_windows(counts, np.flatnonzero(np.frombuffer(data, np.uint8) == 32))
        wide = _reached(text, self.of(data, spans), len(texts))
        narrow = _reached(np.repeat(np.arange(len(texts)), counts), self.of_words([w for words in split for w in words]), len(texts))
        return np.concatenate([wide, narrow], axis=1)


def _reached(text: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts how many windows and which share of them reach each threshold, their number and the farthest."""
    windows = np.bincount(text, minlength=n)
    reach = np.stack([np.bincount(text[distance >= k], minlength=n) for k in THRESHOLDS], axis=1)
    farthest = np.zeros(n, np.int64)
    np.maximum.at(farthest, text, distance)
    return np.concatenate([np.log1p(reach), np.sqrt(reach / np.maximum(1, windows)[:, None]), np.log1p(windows)[:, None], farthest[:, None] / 4], axis=1)


def _thirds(content: bytes) -> bytes:
    """The content, less up to two bytes: zstandard prefers every third place of a dictionary, and what two dictionaries share has to lie alike in both."""
    return content[len(content) % 3 :]


def _trained(size: int, passages: list[bytes], segment: int) -> bytes:
    """What zstandard's trainer takes from the passages; of too few for it, the last ones as they are."""
    if len(passages) >= 100 and sum(map(len, passages)) > 4 * size:
        return _thirds(zstandard.train_dictionary(size, passages, k=segment, d=8, level=3).as_bytes())
    return _thirds(b"".join(passages)[-size:])


def dictionaries(ordinary: list[bytes], toxic: tuple[list[bytes], list[bytes]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from passages; the toxic ones in two halves that share no document."""
    halves = [h or toxic[1 - i] for i, h in enumerate(toxic)]
    first = min(2 * len(ordinary) // (rounds + 2), FIRST)
    base, rest = _trained(BASE, ordinary[:first], 48), ordinary[first:] or ordinary
    common, marked = Counter(w for p in rest for w in p.split()), Counter(w for h in toxic for p in h for w in p.split())
    share = RATIO * marked.total() / max(1, common.total())
    telling = {w for w, n in marked.items() if n > share * (common[w] + 0.5)}
    inner = [_trained(2 * TOXIC[0], h, SEGMENT) for h in halves]
    packed = [_one_by_one(h) for h in halves]
    for r in range(rounds):
        size = round(TOXIC[0] * (TOXIC[1] / TOXIC[0]) ** (r / max(1, rounds - 1)))
        plain, found = compressor(base), []
        for half, mine, other in zip(halves, packed, inner[::-1], strict=True):
            gain = lengths(plain, *mine, FIT_THREADS) - lengths(compressor(base + other), *mine, FIT_THREADS)
            gain[gain > COPIED] = -1
            best = np.argsort(-gain, kind="stable")[: max(200, int(len(gain) * SHARE))]
            found.append(_trained(size, [half[i] for i in best[gain[best] > 0][::-1]], SEGMENT))
        inner = found
        at = r * len(rest) // rounds
        passages = (rest[at:] + rest[:at])[: max(len(rest) // rounds, min(len(rest), POOL))]
        pool = _one_by_one(passages)
        gain = lengths(plain, *pool, FIT_THREADS) - lengths(compressor(base + inner[0] + inner[1]), *pool, FIT_THREADS)
        hard = [i for i in np.argsort(-gain, kind="stable") if gain[i] >= THRESHOLDS[0] and telling.isdisjoint(passages[i].split())]
        room = np.searchsorted(np.cumsum(pool[1][hard, 1]), HARD // rounds, side="right")
        base = _thirds(b"".join(passages[i] for i in hard[:room])) + base
    inner = [_thirds(b" ".join([b"", *(w for w in t.split(b" ") if w in telling), b""])) for t in inner]
    return base, base + inner[0] + inner[1]


@dataclass
class Model:
    """Dictionaries and weights; without weights nothing could be told apart."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[features, np.ones(len(features))] @ self.weights, -30, 30)))


class Scorer:
    """A model with its compressors, for one task."""

    def __init__(self, model: Model):
        self.model = model
        self.distances = Distances(model.ordinary, model.toxic) if model.weights is not None else None

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.zeros(len(texts)) if self.distances is None else self.model.scores(self.distances.features(texts.to_pylist()))


def _calibrate(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (p - y) + decay * w)
    return w


def _passage_batches(batches: Iterator[pa.RecordBatch], shares: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """toxic, half (by document), draw and passage of the windows whose draw, a hash of document and place, is in the share."""
    for batch in batches:
        keys = batch.column("key").to_numpy().view(U64)
        out = [[], [], [], []]
        for text, toxic, key in zip(batch.column("text"), batch.column("toxic").to_pylist(), keys, strict=True):
            words = words_of(text.as_py())
            data = b" %b " % b" ".join(words)
            _, spans = wide_windows(np.array([len(words)]), np.flatnonzero(np.frombuffer(data, np.uint8) == 32))
            draws = splitmix(splitmix(np.full(len(spans), key, U64)) + np.arange(len(spans), dtype=U64))
            for i in np.flatnonzero((draws & U64(_GRAIN - 1)).astype(np.int64) < shares[toxic]):
                start, size = map(int, spans[i])
                for column, value in zip(out, (toxic, int(key & U64(1)), int(draws[i].view(np.int64)), data[start : start + size]), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["toxic", "half", "draw", "passage"])


def _feature_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    distances = Distances(*shared.value)
    for whole in batches:
        for batch in slices(whole, "text", 500_000):
            rows = distances.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["key", "toxic", "x"])


def fit(docs: DataFrame, labels: DataFrame, fit_bytes: tuple[int, int] = FIT_BYTES) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic as 0 or 1)."""
    spark = docs.sparkSession
    share_package(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(totals) < 2:
        return Model()
    share = F.create_map(*(F.lit(x) for k, most in ((0, FIT_ORDINARY), (1, FIT_TOXIC)) for x in (k, int(min(1.0, most / totals[k]) * _GRAIN))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN)) < share[F.col("toxic")])
    # The drawn labels number FIT_TOXIC + FIT_ORDINARY in expectation, 16 bytes each; each brings one text.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(texts.select(F.xxhash64(F.lit("toxicity"), "doc_id").alias("key"), "toxic", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("held")))
    sizes = {r["toxic"]: r["n"] for r in sample.where("not held").groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # two rows
    if not (sizes.get(0) and sizes.get(1)):
        return Model()
    # Windows overlap by WINDOW - STEP words, hence STEP / WINDOW.
    shares = tuple(int(min(1.0, most * STEP / WINDOW / sizes[k]) * _GRAIN) for k, most in enumerate(fit_bytes))
    drawn = sample.where("not held").select("key", "toxic", "text").mapInArrow(lambda b: _passage_batches(b, shares), "toxic int, half int, draw long, passage binary").toArrow().sort_by([("draw", "ascending"), ("passage", "ascending")])
    of = lambda where: drawn.filter(where).column("passage").to_pylist()
    ordinary = of(pa.compute.field("toxic") == 0)
    both = dictionaries(ordinary, tuple(of((pa.compute.field("toxic") == 1) & (pa.compute.field("half") == h)) for h in (0, 1)))
    del drawn, ordinary
    shared = spark.sparkContext.broadcast(both)  # some BASE + HARD + 2 * TOXIC bytes each
    measured = lambda rows: rows.select("key", "toxic", "text").mapInArrow(lambda b: _feature_batches(b, shared), "key long, toxic int, x array<double>").toPandas().sort_values(["key", "toxic"])
    rows = measured(sample.where("held"))
    if rows["toxic"].nunique() < 2:  # too few labels to hold any back
        rows = measured(sample)
    return Model(*both, _calibrate(np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(np.float64)))


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(shared.value)
    for whole in batches:
        for batch in slices(whole, "text", 500_000):
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scorer.scores(batch.column("text")), pa.float64())], names=[*keep, "score"])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The ``keep`` columns plus score and predicted for every row."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries, some megabytes whatever the input
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: _score_batches(b, shared), f"{kinds}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic, all columns kept."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                yield batch.filter(pa.array(scorer.scores(batch.column("text")) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
