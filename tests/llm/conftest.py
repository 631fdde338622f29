from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=False):
        rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        # Names that the operators use inside.
        return df.selectExpr("*", *(f"doc_id AS {c}" for c in ("row", "n_words", "_lines", "_bad_id", "key", "fp", "part", "score", "salt", "_doc", "version"))) if extra else df

    return make


#: Nulls, empty and blank texts, ties, repeats, other scripts, surrogate pairs, a very long text.
ODD = [None, "", " ", "\n\n", "a", "word " * 3, "x" * 200_000, "Ünï çødé 日本語 \U0001f600 text", "same text here", "same text here", "\x00\x01 tab\tline\r\nend", "12 34 " * 5000]
