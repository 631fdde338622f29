"""Fill-in-middle against a plain version on str, and its index over long texts and small steps."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex
from llm.conftest import ODD
from pyspark.sql import functions as F

from tallystone.llm import infill

WORDS = rb"[^ \n]+[ \n]*"


def plain_version(doc_id, text, pattern=None):
    text = text or ""
    marks = list(range(len(text))) if pattern is None else [m.start() for m in regex.finditer(pattern.decode(), text)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(marks)
    if not text or any(x in text for x in infill.SENTINELS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = (([*marks, len(text)])[c] for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [*ODD, "has <P> inside", "ends with <", "a<S", "<M", "\n ", *(f"short {i} é日\U0001f600 " * (i % 7) for i in range(60))]


@pytest.mark.parametrize("unit", [None, WORDS])
@pytest.mark.parametrize("every", [1, 3, 512])
def test_equals_plain_version(docs_of, unit, every):
    docs = docs_of(TEXTS, extra=True)
    docs = docs.unionByName(docs.where("doc_id IN (4, 8)")).unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    made = infill.fill_in_middle(docs, unit=unit, every=every)
    rows = made.withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    text_of = dict(enumerate(TEXTS)) | {None: TEXTS[10]}
    assert len(rows) == len(TEXTS) + 3
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r)[:6] == plain_version(r["doc_id"], text_of[r["doc_id"]], unit)
        assert r["again"] == (text_of[r["doc_id"]] or "")


def test_empty_table_and_other_sentinels(docs_of):
    assert infill.fill_in_middle(docs_of([])).collect() == []
    marks = ("[pre]", "[suf]", "[mid]")
    rows = infill.fill_in_middle(docs_of(["keeps <P> and <S>", "has [suf]"] * 20), sentinels=marks, cut_rate=100)
    found = rows.select("doc_id", "form", infill.restored(F.col("form"), F.col("output"), marks).alias("again")).collect()
    assert {r["again"] for r in found if r["doc_id"] % 2 == 0} == {"keeps <P> and <S>"}
    assert all((r["form"] == "plain") == (r["doc_id"] % 2 == 1) for r in found)


@pytest.mark.parametrize("pattern", [None, WORDS])
def test_cuts_of_a_long_text(pattern):
    """Units, byte and code-point offsets stay right across blocks and checkpoints."""
    rng = random.Random(3)
    text = "".join(rng.choice("ab é日\U0001f600\n") for _ in range(150_000))
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(data) > 3 * infill.BLOCK
    compiled = regex.compile(pattern) if pattern else None
    index = infill.checkpoints(data, compiled)
    marks = [*(range(len(text)) if pattern is None else (m.start() for m in regex.finditer(pattern.decode(), text))), len(text)]
    assert index.n == len(marks) - 1
    assert len(index.units) <= 2 + index.n // infill.EVERY + 1  # sparse
    for cut in [0, 1, infill.EVERY, index.n - 1, index.n, *rng.choices(range(index.n), k=300)]:
        assert index.locate(cut) == (len(text[: marks[cut]].encode()), marks[cut])
