"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a zstandard stream in the public seekable layout: frames of some ``FRAME_TOKENS`` ids, each decompressible by
itself, then skippable frames that plain decompressors pass over: one with the documents' ids and ends, and last the
seek table with every frame's compressed size, size and checksum (XXH64, lower half). Ids are little-endian unsigned
32-bit integers, the documents' one behind the other. A reader takes the two tables from the end of the file, finds the
frames of the documents asked for, decompresses these alone and holds them against their checksums. A document longer
than a frame goes on in the next one, so no frame grows with a text.

Writing: rows are range-partitioned by doc_id and sorted, each task writes its range as files of some ``FILE_TOKENS``
ids, and the list of files with the number of ids before each is stored beside them as Parquet. File names hold the
task's attempt: what a lost or repeated attempt wrote is never listed. Paths are any that pyarrow's file systems and
Spark both reach. Reading: a task a file, or, for chosen documents, a shuffle of their ids to the files they are in.

Edge cases: null and empty texts have no ids but the end id, if there is one; null doc_ids come first; rows of one
doc_id follow each other by a hash of their texts; repeated rows are documents of their own; an empty table makes an
empty list of files and reads as no rows; other columns are ignored; a file that was cut short or changed is an error
on reading; doc_ids must be whole numbers.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallystone.llm.bpe import byte_letters
from tallystone.llm.textbatch import slices, text_bytes
from tallystone.session import share_package

FRAME_TOKENS = 1 << 16
FILE_TOKENS = 1 << 26
LEVEL = 3
#: Pieces of texts are remembered up to so many, of so many bytes, then forgotten together.
CACHE = 400_000
LONGEST = 48
#: Texts are encoded some bytes at a time.
RUN_BYTES = 8_000_000

# Fixed values of the zstandard and seekable formats.
SKIPPABLE_DOCUMENTS = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEK_TABLE_END = 0x8F92EAB1
CHECKSUMS = 0x80

#: Fixed value: how the tokenizers of this kind split lower-cased texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLANK, _LETTER, _DIGIT, _SYMBOL, _WHOLE = range(5)
_KINDS = np.full(256, _WHOLE, np.uint8)
_KINDS[33:127] = _SYMBOL
_KINDS[[9, 10, 11, 12, 13, 32]] = _BLANK
_KINDS[48:58] = _DIGIT
_KINDS[97:123] = _LETTER
_KINDS[[39, 124]] = _WHOLE
#: First bytes of U+00C0 to U+027F and of U+0400 to U+047F; a multiplication and a division sign, and the capital whose lower case is two code points.
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xCA] = _LEADS[0xD0:0xD2] = True
_NO_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0])
_LETTERS = re.compile(rb"(?:[a-z]|[\xc3-\xc9\xd0\xd1][\x80-\xbf])+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_FILES = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts (UTF-8, one behind the other), and how many of them stand before each text and its end.

    Between ASCII blanks, runs of letters, single digits and runs of symbols are what the word pattern takes apart, so
    each is encoded as in the whole, A-Z lower-cased. Letters are those of ASCII and of the blocks in which all two-byte
    code points are letters that compose with nothing. A run between blanks that holds an apostrophe, a bar (special
    strings have one), a control character or another code point stays one piece as it is.
    """
    low = _LOWER[data]
    kind = _KINDS[low]
    lead = np.flatnonzero(_LEADS[data[:-1]])
    lead = lead[~np.isin(data[lead].astype(np.int32) << 8 | data[lead + 1], _NO_LETTERS)]
    kind[lead] = kind[lead + 1] = _LETTER
    solid = kind != _BLANK
    parted = np.zeros(len(low), bool)  # the byte before is a blank or of another text
    parted[1:] = ~solid[:-1]
    parted[offsets[:-1][offsets[:-1] < len(low)]] = True
    runs = np.flatnonzero(solid & parted)
    changed = parted.copy()
    changed[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(solid & (changed | (kind == _DIGIT)))
    if len(runs):
        whole = np.add.reduceat(kind == _WHOLE, runs) > 0
        run = np.searchsorted(runs, starts, side="right") - 1
        starts = starts[~whole[run] | (starts == runs[run])]
        as_is = np.repeat(whole, np.diff(runs, append=len(low)))
        low[runs[0] :][as_is] = data[runs[0] :][as_is]
    # Pieces cover all bytes but the blanks, so they lie one behind the other once those are gone.
    places = np.concatenate([[0], np.cumsum(solid)])
    bounds = np.append(places[starts], places[-1]).astype(np.int32)
    spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[solid])])
    return spelled, np.searchsorted(starts, offsets)


class Encoder(dict):
    """Texts to packed ids by a tokenizer file; piece of a text -> its ids.

    A tokenizer that lower-cases, drops white space and splits by the word pattern is given each different piece of the
    texts once (as long as it is remembered), any other the whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {b: letter for letter, b in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = lambda key, inner: [p for p in ((spec.get(key) or {}).get(inner) or [])]
        before = parts("pre_tokenizer", "pretokenizers")
        self.by_pieces = (
            [p["type"] for p in parts("normalizer", "normalizers")] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"] == {"Regex": WORD_PATTERN}
            and all("|" in t["content"] and not t["normalized"] for t in spec["added_tokens"])
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        others, pack = [], struct.Struct("<I").pack
        merged = self.tokenizer.model.tokenize
        for w in new:
            # A run of lower-case letters is one word, and normal as it is: the library's model takes it from there.
            if w.isalpha() or (_LETTERS.fullmatch(w) and (s := w.decode()).isalpha() and s == s.lower()):
                self[w] = b"".join([pack(t.id) for t in merged(w.decode("latin-1").translate(self.letters))])
            else:
                others.append(w)
        self.update(zip(others, self._whole([w.decode() for w in others]), strict=True))

    def packed(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        if not self.by_pieces:
            return self._whole(column.fill_null("").to_pylist())
        data, offsets = text_bytes(column)
        spelled, first = pieces(data, offsets)
        coded = spelled.dictionary_encode()
        known = coded.dictionary.to_pylist()
        new = [w for w in known if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = known
        self._learn(new)
        ids = [*map(self.__getitem__, known)]
        for w in new:
            if len(w) > LONGEST:
                del self[w]
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(each) - each
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = each[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(begins[at] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[first]).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


encoder = lru_cache(maxsize=2)(Encoder)


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"(file:|/)", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).lstrip("/")
    return fs.FileSystem.from_uri(path)


class Writer:
    """One file; ``add`` documents in order, then ``close``."""

    def __init__(self, path: str, frame_tokens: int = FRAME_TOKENS):
        where, place = file_system(path)
        self.out = where.open_output_stream(place, compression=None)
        self.frame = 4 * frame_tokens
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        self.held = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.tokens = self.bytes = 0

    def _flush(self, upto: int) -> None:
        raw = bytes(self.held[:upto])
        del self.held[:upto]
        packed = self.compress(raw)
        self.frames.append((len(packed), len(raw), _checksum(raw)))
        self._write(packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and len(self.held) + len(ids) > self.frame:
            self._flush(len(self.held))
        self.held += ids
        while len(self.held) > self.frame:
            self._flush(self.frame)
        self.tokens += len(ids) // 4
        self.ids.append(doc_id)
        self.ends.append(self.tokens)

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        nulls = sum(i is None for i in self.ids)  # they come first
        table = struct.pack("<QQ", len(self.ids), nulls) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes()
        self._write(_skippable(SKIPPABLE_DOCUMENTS, table + struct.pack("<I", _checksum(table))))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self._write(_skippable(SKIPPABLE_SEEK_TABLE, entries + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_TABLE_END)))
        self.out.close()


class Reader:
    """One file: its documents' ids and places, and the ids of any of them."""

    def __init__(self, path: str):
        where, place = file_system(path)
        self.file = where.open_input_file(place)
        size = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_TABLE_END or kind != CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums at the end")
        seek = size - 17 - 12 * n
        self.frames = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        #: Where frames begin: in the file, and in the ids' bytes.
        self.places, self.starts = (np.concatenate([[0], np.cumsum(self.frames[:, k])]) for k in (0, 1))
        data_end = int(self.places[-1])
        table = self._at(data_end + 8, seek - data_end - 8)
        if struct.unpack("<I", table[-4:])[0] != _checksum(table[:-4]):
            raise ValueError(f"{path}: the table of documents does not match its checksum")
        docs, nulls = struct.unpack("<QQ", table[:16])
        self.ids: list[int | None] = [None] * nulls + np.frombuffer(table, "<i8", docs, 16)[nulls:].tolist()
        self.bounds = np.concatenate([[0], np.frombuffer(table, "<u8", docs, 16 + 8 * docs).astype(np.int64)])
        self.path, self.nulls = path, nulls
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed, size, checksum = self.frames[i].tolist()
            raw = self.decompress(self._at(int(self.places[i]), packed), max_output_size=size)
            if len(raw) != size or _checksum(raw) != checksum:
                raise ValueError(f"{self.path}: frame {i} does not match its checksum")
            self.last = (i, raw)
        return self.last[1]

    def document(self, i: int) -> bytes:
        """The packed ids of the file's i-th document, from the frames that hold it alone."""
        start, end = 4 * int(self.bounds[i]), 4 * int(self.bounds[i + 1])
        parts = []
        frame = int(np.searchsorted(self.starts, start, side="right")) - 1
        while start < end:
            base = int(self.starts[frame])
            parts.append(self._frame(frame)[start - base : end - base])
            start = base + len(self.last[1])
            frame += 1
        return b"".join(parts)

    def places_of(self, doc_id: int | None) -> range:
        """Where the file has documents of this id."""
        if doc_id is None:
            return range(self.nulls)
        known = np.array(self.ids[self.nulls :], np.int64)
        return range(self.nulls + int(np.searchsorted(known, doc_id)), self.nulls + int(np.searchsorted(known, doc_id, side="right")))

    def close(self) -> None:
        self.file.close()


def _write_batches(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end: int | None, frame_tokens: int, file_tokens: int) -> Iterator[pa.RecordBatch]:
    codec, task = encoder(tokenizer), TaskContext.get()
    tail = b"" if end is None else struct.pack("<I", end)
    writer, rows, name = None, [], ""

    def closed() -> dict:
        writer.close()
        return dict(part=task.partitionId(), seq=len(rows), file=name, n_docs=len(writer.ids), n_tokens=writer.tokens, n_bytes=writer.bytes, first_id=writer.ids[0], last_id=writer.ids[-1])

    for whole in batches:
        for batch in slices(whole, "text", RUN_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codec.packed(batch.column("text")), strict=True):
                if writer is None:
                    name = f"{task.partitionId():06d}-{len(rows):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids.zst"
                    writer = Writer(f"{path}/{name}", frame_tokens)
                writer.add(doc_id, ids + tail)
                if writer.tokens >= file_tokens:
                    rows.append(closed())
                    writer = None
    if writer is not None:
        rows.append(closed())
    kinds = {"part": pa.int32(), "seq": pa.int32(), "file": pa.string()}
    names = [c.split(" ")[0] for c in _FILES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in names], names=names)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = None, frame_tokens: int = FRAME_TOKENS, file_tokens: int = FILE_TOKENS
) -> None:
    """Write the ids of all documents (doc_id, text) to a new folder, in ascending order of doc_id; ``end`` closes each document."""
    spark = docs.sparkSession
    share_package(spark)
    where, place = file_system(path)
    where.create_dir(place)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row's number deals repeats of one row over tasks like any others.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_row")]
    keyed = rows.withColumn("_text", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = dealt.mapInArrow(lambda b: _write_batches(b, path, tokenizer, end, frame_tokens, file_tokens), _FILES)
    files = sorted(map(tuple, found.collect()))  # a row a file
    before, listed = 0, []
    for f in files:
        listed.append((*f, before))
        before += f[4]
    spark.createDataFrame(listed, f"{_FILES}, start long").coalesce(1).write.parquet(f"{path}/files.parquet")


def token_files(spark: SparkSession, path: str) -> list:
    """The files of a folder in order: file, n_docs, n_tokens, n_bytes, first_id, last_id and start, the ids before it."""
    return spark.read.parquet(f"{path}/files.parquet").orderBy("start", "part", "seq").collect()


def _documents(path: str, files: list, chosen: Iterator[tuple[int, list | None]]) -> Iterator[pa.RecordBatch]:
    """The documents of (file, doc_ids; None for all) pairs, some at a time."""
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids"])

    for number, wanted in chosen:
        reader = Reader(f"{path}/{files[number]['file']}")
        for i in range(len(reader.ids)) if wanted is None else (i for d in wanted for i in reader.places_of(d)):
            ids = reader.document(i)
            rows.append((reader.ids[i], files[number]["start"] + int(reader.bounds[i]), len(ids) // 4, ids))
            size += len(ids)
            if size > 8_000_000:
                yield batch()
                rows, size = [], 0
        reader.close()
    yield batch()


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (packed) of all documents, or of the ``wanted`` doc_ids."""
    share_package(spark)
    files = [r.asDict() for r in token_files(spark, path)]
    shared = spark.sparkContext.broadcast(files)  # a row a file of FILE_TOKENS ids
    out = "doc_id long, start long, n_tokens long, ids binary"
    if wanted is None:
        every = lambda b: ((i, None) for batch in b for i in batch.column("id").to_pylist())
        return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(lambda b: _documents(path, shared.value, every(b)), out)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[f[c] if f[c] is not None else -(1 << 63) for f in shared.value] for c in ("first_id", "last_id")]
        first, last = (np.array(x, np.int64) for x in lists)
        for batch in batches:
            ids = batch.column("doc_id")
            keys = ids.fill_null(-(1 << 63)).to_numpy()
            low, high = np.searchsorted(last, keys), np.searchsorted(first, keys, side="right")
            n = np.maximum(0, high - low)
            at = np.repeat(np.arange(len(keys)), n)
            number = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(number, pa.int32())], names=["doc_id", "file"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        held, asked = None, []
        for batch in batches:
            for doc_id, number in zip(batch.column("doc_id").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if number != held:
                    if asked:
                        yield held, asked
                    held, asked = number, []
                asked.append(doc_id)
        if asked:
            yield held, asked

    asks = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(placed, "doc_id long, file int")
    return asks.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(lambda b: _documents(path, shared.value, grouped(b)), out)
