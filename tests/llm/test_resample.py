"""Importance resampling against a plain version that spells out every feature."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from llm.conftest import ODD
from pyspark.sql import functions as F

from tallystone.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n, buckets):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_version(docs, target, n=2, buckets=10_000, percent=25, least=20):
    corpus = Counter(b for _, t in docs for b in features(t, n, buckets)[1])
    aim = Counter(b for t in target for b in features(t, n, buckets)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (t_all := float(s + buckets)) / ((corpus[b] + 1) * float(t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, found = features(text, n, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mé", "日", "x1") for b in range(40)]
    return [*ODD, *(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 90))) for _ in range(300)), "the same words again and again " * 6]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_plain_version(spark, docs_of, texts, n, monkeypatch):
    """Short runs too, so that texts come under several dictionaries."""
    monkeypatch.setattr(resample, "RUN_BYTES", 4_000)
    docs = docs_of(texts, extra=True)
    docs = docs.unionByName(docs.where("doc_id IN (20, 30, 40)")).unionByName(docs.where("doc_id = 50").withColumn("doc_id", F.lit(None).cast("long")))
    target = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *texts[20:40], "Lo3 ka5 ka5"])], "item_id long, text string")
    rows = resample.resampled(docs, target, n=n, buckets=500).collect()
    pairs = [*enumerate(texts), *((i, texts[i]) for i in (20, 30, 40)), (None, texts[50])]
    assert Counter(map(tuple, rows)) == plain_version(pairs, [None, "", *texts[20:40], "Lo3 ka5 ka5"], n, 500)


def test_empty_tables(spark, docs_of, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(docs_of([]), none).collect() == []
    rows = resample.resampled(docs_of(texts[:40]), none).collect()
    assert Counter(map(tuple, rows)) == plain_version([*enumerate(texts[:40])], [])


def test_few_or_none_to_draw(spark, docs_of):
    none = spark.createDataFrame([("a b",)], "text string")
    assert {r["rank"] for r in resample.resampled(docs_of(["too short"] * 50), none).collect()} == {None}
    assert {r["rank"] for r in resample.resampled(docs_of(["word " * 30] * 3), none).collect()} == {None}  # a quarter of 3 is none


def test_ranks_across_bands_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([-700, -3, 0, 255, 256, 900, rng.randrange(-5000, 5000)]), rng.random() < 0.8) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, ok boolean")
    got = {r["doc_id"]: r["rank"] for r in resample.with_rank(df.select("doc_id", "score", "ok"), F.col("ok"), 40).collect()}
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    want = {r[0]: i + 1 for i, r in enumerate(order[: len(order) * 40 // 100])}
    assert got == {r[0]: want.get(r[0]) for r in rows}


def test_target_like_texts_are_preferred(spark, docs_of):
    rng = random.Random(9)
    near, far = ([" ".join(rng.choices(w, k=60)) for _ in range(200)] for w in ("alpha beta gamma delta".split(), "one two three four".split()))
    target = spark.createDataFrame([("alpha beta gamma delta " * 20,)], "text string")
    rows = resample.resampled(docs_of([*near, *far]), target).where("rank IS NOT NULL").collect()
    assert len(rows) == 100
    assert sum(r["doc_id"] < 200 for r in rows) > 80
