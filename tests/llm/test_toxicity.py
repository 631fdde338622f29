"""Compression distances against a plain version, and texts and labels of every odd kind."""

from __future__ import annotations

import numpy as np
import pytest
from llm.conftest import ODD

from tallystone.llm import toxicity

SYLLABLES = ["ba", "de", "fi", "go", "lu", "mar", "nes", "pol", "rus", "tin", "ka", "vo"]


def _word(rng):
    return "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))


def _corpus(n, seed, odd=()):
    """Texts of made-up words; every fourth is toxic and holds words that begin with a stem of its own."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [_word(rng) for _ in range(rng.integers(20, 200))]
        if i % 4 == 0:
            for at in rng.integers(0, len(words), 6):
                words[at] = str(rng.choice(["wexqual", "zhomp"])) + "".join(rng.choice(["er", "ing", "ost", "ab", "y"], 2))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = _corpus(600, 3)
    return toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))


def _plain_features(text, model):
    """Every window compressed by itself."""
    plain, toxic = (toxicity.compressor(d) for d in (model.ordinary, model.toxic))
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).split(" ")
    words = ["".join(c.lower() if c < "\x80" else c for c in w).encode() for w in words if w]
    wide = [b" " + b" ".join(words[at : at + toxicity.WINDOW]) + b" " for at in range(0, len(words), toxicity.STEP) if at == 0 or at + toxicity.WINDOW - toxicity.STEP < len(words)]
    narrow = [b"\x01" * 12 + b" " + w + b" " + b"\x01" * 12 for w in words]
    out = []
    for windows in (wide, narrow):
        d = [len(plain.compress(w)) - len(toxic.compress(w)) for w in windows]
        reach = [sum(x >= k for x in d) for k in toxicity.THRESHOLDS]
        out += [*np.log1p(reach), *(np.sqrt(r / max(1, len(d))) for r in reach), np.log1p(len(d)), max([0, *d]) / 4]
    return out


def test_features_equal_a_plain_version(model):
    texts = [t if t is None or len(t) < 50_000 else t[:9_000] for t in ODD] + [r[1] for r in _corpus(20, 8)] + ["one", "a b c d e f", "a b c d e f g", "A-b! c_d"]
    got = toxicity.Distances(model.ordinary, model.toxic).features(texts)
    assert np.allclose(got, [_plain_features(t, model) for t in texts])


def test_words_never_seen_are_caught_by_their_letters(spark, model):
    rows = _corpus(200, 77)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model, "doc_id").collect()}
    y = np.array([r[2] for r in rows])
    p = np.array([got[r[0]] for r in rows])
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() <= 0.05


def test_scores_do_not_depend_on_neighbours(model, monkeypatch):
    texts = [r[1] for r in _corpus(30, 5)]
    together = toxicity.Distances(model.ordinary, model.toxic).features(texts)
    monkeypatch.setattr(toxicity, "CACHE", 50)
    few = toxicity.Distances(model.ordinary, model.toxic)
    assert (np.concatenate([few.features([t]) for t in texts]) == together).all()


def test_odd_texts(spark, docs_of, model):
    texts = [*ODD, "word " * 300_000, "same", "same"]
    rows = toxicity.score(docs_of(texts, True), model, "doc_id").collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(texts) and all(0 <= x <= 1 for x in got.values())
    assert got[0] == got[1] == got[2] == got[3] and got[len(texts) - 1] == got[len(texts) - 2]
    assert toxicity.score(docs_of([]), model, "doc_id").count() == 0 and toxicity.drop_toxic(docs_of([]), model).count() == 0
    twice = docs_of(["same", None]).union(docs_of(["same", None])).selectExpr("*", "1 AS score", "doc_id AS predicted")
    kept = toxicity.drop_toxic(twice, model)
    assert kept.columns == twice.columns and kept.count() == 4


def test_labels_of_one_class_reject_nothing(spark, docs_of):
    docs = docs_of(["some text", "more text", None])
    for labels in ([], [(0, 1)], [(0, 0), (1, 0)], [(0, None), (None, 1)], [(9, 1), (8, 0)], [(2, 1), (0, 0)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.score(docs, m, "doc_id").collect()] == [0.0] * 3 and toxicity.drop_toxic(docs, m).count() == 3


def test_repeated_ids_count_once(spark):
    rows = _corpus(60, 4)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.union(docs).union(docs), labels.union(labels))
    assert (one.ordinary, one.toxic) == (two.ordinary, two.toxic) and np.allclose(one.weights, two.weights)
