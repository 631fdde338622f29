"""Token files against the tokenizers library, their layout, and readers that want single documents."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from llm.conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallystone.llm import tokenfile
from tallystone.llm.queries import op11_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_version(library, pairs, end=1):
    """(doc_id, start, n_tokens, ids) of (doc_id, text) pairs that stand in order."""
    out, at = [], 0
    for doc_id, text in pairs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])]
        out.append((doc_id, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def collected(df):
    return [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in df.collect()]


TEXTS = [*ODD, "<|endoftext|> inside<|startoftext|>it", "é ́x ö", "a b c\x1cd\x85e\x0bf", "It's WE'LL ΑΣ Σ İ ǆ ﬁ ① ½", "ha" * 3000]


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, docs_of, library, tmp_path, small):
    """Also with frames and files far smaller than the documents."""
    docs = docs_of(TEXTS, extra=True).repartition(3)
    limits = dict(frame_tokens=7, file_tokens=500) if small else {}
    tokenfile.write_tokens(docs, str(tmp_path / "t"), PATH, 1, **limits)
    want = plain_version(library, enumerate(TEXTS))
    assert sorted(collected(tokenfile.read_tokens(spark, str(tmp_path / "t")))) == want
    files = tokenfile.token_files(spark, str(tmp_path / "t"))
    assert (len(files) > 2) == small
    assert [f["start"] for f in files] == [sum(g["n_tokens"] for g in files[:i]) for i in range(len(files))]
    wanted = spark.createDataFrame([(3,), (3,), (6,), (16,), (999,), (-1,), (None,)], "doc_id long")
    assert sorted(collected(tokenfile.read_tokens(spark, str(tmp_path / "t"), wanted))) == [w for w in want if w[0] in (3, 6, 16)]


def test_pieces_are_encoded_as_in_the_whole(library):
    rng = random.Random(4)
    letters = [*"abstmdrelvABS", "\u00e9", "e\u0301", "\u0301", "\u65e5", "7", "42", "'s", "'ll", "'", "-", "<", "|", ".", "...", "<|", "|>", "\U0001f600", "\u03a3", "\u0130", "\u2014", "\x00", "\x7f", "\u00df", "\u00d7", "\u00f7", "\u00c4", "\u017f", "\u01c5", "\u0149", "\u027f", "\u0431", "\u0419", "\u0482", "\u0280", "\uf900"]
    letters += [*" \t\n\x0b\x0c\r", "\x1c", "\x85", "\xa0", "\u2003", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(12000)] + TEXTS
    codec = tokenfile.Encoder(PATH)
    assert codec.by_pieces
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert codec.packed(pa.array(texts)) == want
    assert codec.packed(pa.array(texts)) == want  # from memory
    assert codec.packed(pa.array(texts).slice(100, 50)) == want[100:150]
    assert codec.packed(pa.array([], pa.string())) == []


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 20)
    codec = tokenfile.Encoder(PATH)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}x" for j in range(12)) + " " + "long" * 20 for i in range(60)]
    for i in range(0, 60, 5):
        assert codec.packed(pa.array(texts[i : i + 5])) == [np.array(library.encode(t).ids, "<u4").tobytes() for t in texts[i : i + 5]]
        assert len(codec) <= 70 and max(map(len, codec)) <= tokenfile.LONGEST


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec = tokenfile.Encoder(path)
    assert not codec.by_pieces
    assert codec.packed(pa.array(TEXTS)) == [np.array(Tokenizer.from_file(path).encode(t or "").ids, "<u4").tobytes() for t in TEXTS]


def test_null_ids_repeats_and_ties(spark, library, tmp_path):
    rows = [(None, "no id"), (5, "b text"), (5, "a text"), (5, "a text"), (1, None), (1, None), (9, "last"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(3))
    tokenfile.write_tokens(df, str(tmp_path / "t"), PATH, None, frame_tokens=2, file_tokens=3)
    got = sorted(collected(tokenfile.read_tokens(spark, str(tmp_path / "t"))), key=lambda r: (r[1], r[2], r[0] or 0))
    assert sorted((r[0] or -1, r[3]) for r in got) == sorted((i or -1, w[3]) for (i, _), w in zip(rows, plain_version(library, rows, None), strict=True))
    assert [r[0] for r in got if r[2]] == sorted((r[0] for r in got if r[2]), key=lambda i: -1 if i is None else i)  # ascending, nulls first
    assert [r[1] for r in got if r[2]] == list(np.cumsum([0] + [r[2] for r in got if r[2]][:-1]))
    five = collected(tokenfile.read_tokens(spark, str(tmp_path / "t"), spark.createDataFrame([(5,), (None,)], "doc_id long")))
    assert sorted((r[0] or -1) for r in five) == [-1, -1, 5, 5, 5]


def test_empty_table(spark, docs_of, tmp_path):
    tokenfile.write_tokens(docs_of([]), str(tmp_path / "t"), PATH, 1)
    assert tokenfile.token_files(spark, str(tmp_path / "t")) == []
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).collect() == []
    assert tokenfile.read_tokens(spark, str(tmp_path / "t"), spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_layout(tmp_path):
    """Any zstandard reader gets the ids; the table at the end tells frames, sizes and checksums; few frames are read for one document."""
    path = str(tmp_path / "x")
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50_000, rng.integers(0, 300)).astype("<u4").tobytes()) for i in range(0, 400, 2)]
    writer = tokenfile.Writer(path, frame_tokens=256)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    whole = open(path, "rb").read()
    reader = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True)
    assert reader.read() == b"".join(ids for _, ids in docs)
    n, kind, magic = struct.unpack("<IBI", whole[-9:])
    assert (kind, magic) == (0x80, 0x8F92EAB1)
    entries = struct.iter_unpack("<III", whole[-9 - 12 * n : -9])
    assert sum(size for _, size, _ in entries) == sum(len(ids) for _, ids in docs)
    found = tokenfile.Reader(path)
    frames = []
    found._frame, inner = (lambda i: (frames.append(i), inner(i))[1]), found._frame
    assert [found.document(i) for i in found.places_of(200)] == [docs[100][1]]
    assert 1 <= len(frames) <= 3 < n
    assert list(found.places_of(201)) == []


def test_damage_is_an_error(tmp_path):
    path = str(tmp_path / "x")
    writer = tokenfile.Writer(path, frame_tokens=50)
    for i in range(20):
        writer.add(i, np.arange(40, dtype="<u4").tobytes())
    writer.close()
    whole = bytearray(open(path, "rb").read())
    for bad, seen in ((whole[:-3], "seek table"), (whole[:-200] + bytes([whole[-200] ^ 1]) + whole[-199:], None)):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError, match=seen):
            reader = tokenfile.Reader(path)
            [reader.document(i) for i in range(20)]
    # A checksum in the seek table that another frame's bytes had.
    n = struct.unpack("<I", whole[-9:-5])[0]
    entry = len(whole) - 9 - 12 * n
    whole[entry + 8] ^= 1
    open(path, "wb").write(whole)
    with pytest.raises(ValueError, match="frame 0"):
        tokenfile.Reader(path).document(0)


def test_query(spark, small, library):
    docs = sorted(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    got = sorted(map(tuple, op11_token_files(spark, small).collect()))
    assert got == [(i, at, n, zlib.crc32(ids)) for i, at, n, ids in plain_version(library, docs)]
