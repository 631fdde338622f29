"""Nearest centroids against a plain version, rejection of languages that were not learned, repeated rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tallystone.llm import langid

SYLLABLES = {
    "aa": "ka to mi re su na ho ri ku ta".split(),
    "bb": "sch ung ein lich kei ver ge zu auf ich".split(),
    "cc": "eau tion ment ois que leur par aux".split(),
    "zz": "xqz wjk vvp qqx jzw kxk".split(),
}


def _text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    return [(i, _text(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 120)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def _plain_counts(text):
    """Hashed byte bigrams and trigrams, one by one."""
    read = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    out = Counter()
    for i in range(len(read) - 1):
        pair = read[i] << 8 | read[i + 1]
        out[pair * 2654435761 % (1 << 32) >> 20] += 1
        if i + 2 < len(read):
            out[((pair << 8 | read[i + 2]) ^ 0x5BD1E995) * 2246822519 % (1 << 32) >> 20] += 1
    return out


def test_prediction_equals_a_plain_version(spark, rows, model):
    texts = [r[1] for r in rows]
    held = Counter(f for t in texts for f in _plain_counts(t))
    idf = [math.log((1 + len(texts)) / (1 + held[i])) + 1 for i in range(langid.DIMENSIONS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    rng = np.random.default_rng(8)
    some = [_text(rng, lang, 20) for lang in ("aa", "bb", "cc", "zz") * 5]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model, "doc_id").collect()}
    for i, t in enumerate(some):
        v = {f: math.log1p(n) * idf[f] for f, n in _plain_counts(t).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x / length * float(c[f]) for f, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i]["lang_pred"] == model.languages[model.owner[best]] and abs(got[i]["score"] - cosines[best]) < 1e-4


def test_unlearned_languages_are_rejected_and_learned_ones_not(spark, model):
    rng = np.random.default_rng(31)
    texts = [(i, _text(rng, lang)) for i, lang in enumerate(["aa", "bb", "cc", "zz"] * 60)]
    texts += [(1000 + i, "дом мир вода земля солнце " * 9) for i in range(20)]
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model, "doc_id").collect()}
    learned = [got[i] for i in range(240) if i % 4 < 3]
    assert np.mean(learned) <= 0.05 and all(got[i] for i in range(240) if i % 4 == 3) and all(got[i] for i in range(1000, 1020))


def test_repeated_rows(spark, rows, model):
    """A row repeated very often counts for document frequencies, but is one text of the sample."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = df.where("doc_id = 4").selectExpr("doc_id", "text", "lang", "explode(sequence(1, 300)) AS i").drop("i")
    skewed = langid.fit(df.union(often), 10_000)
    drawn = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, skewed, "doc_id").collect()}
    assert all(drawn[i] == lang for i, _, lang in rows)
    assert langid.predict(df.union(df), model, "doc_id").count() == 2 * len(rows)


def test_many_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, _text(rng, "aa", 12), f"l{i % 60}") for i in range(240)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 60 and len(model.centroids) <= 180
