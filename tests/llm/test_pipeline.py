"""The pipeline against a plain version of its stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from llm.test_brute_force import _encoding, _plain_components, _plain_fingerprint

from tallystone.llm import columns, queries


def _plain_lines(docs):
    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(h := holders.get(key(line), ())) >= 3 and i != max(h)
    return {i: t if not any(gone(i, x) for x in (t or "").split("\n")) else "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}


def _plain_contaminated(text, windows):
    import re

    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= {*range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline(spark, small):
    import re

    table = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, small).where("predicted = 1").collect()}
    docs = _plain_lines({r["doc_id"]: r["text"] for r in table.orderBy("doc_id").collect() if r["doc_id"] not in toxic})
    ids = list(docs)
    roots = _plain_components(ids, [_plain_fingerprint(docs[i]) for i in ids])
    kept = [i for i, r in zip(ids, roots, strict=True) if i == r]
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} - {()}
    clean = [i for i in kept if not _plain_contaminated(docs[i], windows)]
    e = _encoding()
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: (e.encode_ordinary(docs[i] or ""), docs[i] or "") for i in clean}


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_keys_go_by_broadcast_or_by_shuffle(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = [s for name, s in corpus_pipeline.STAGES if name in ("simhash", "decontaminate")]
    ids = lambda stage: sorted(r["doc_id"] for r in stage(spark, docs, small).collect())
    few = [ids(s) for s in stages]
    monkeypatch.setattr(columns, "BROADCAST_ROWS", -1)
    assert [ids(s) for s in stages] == few and all(len(x) < docs.count() for x in few)


def test_odd_documents(spark, docs_of, tmp_path):
    """Nulls in any column, repeated rows, an empty table and names that the stages use themselves."""
    line = "A line that many of the documents hold"
    texts = [None, "", line, f"{line}\none", f"{line}\ntwo words", "short item", "short item", "x" * 50_000]
    docs = docs_of(texts, True)
    docs = docs.union(docs.where("doc_id = 5")).union(docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", *docs.columns[5:]).where("text = 'short item' OR text IS NULL"))
    spark.createDataFrame([(1, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    # One of the three empty texts stays of those with an id, null ids stay; "short item" is the benchmark's, whoever holds it.
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in now.select("doc_id", "text").where("doc_id IS NOT NULL").collect()) == [(False, 0, None), (False, 3, "one"), (False, 4, f"{line}\ntwo words"), (False, 7, "x" * 50_000)]
    assert [r["text"] for r in now.where("doc_id IS NULL").collect()] == [None]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
