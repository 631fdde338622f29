"""Byte-pair merging over linked bytes, with the ranks of public vocabulary files.

Vocabulary files are parameters, paths that the executors can read; they are loaded once a worker process. Results for
pre-tokens of up to ``LONGEST`` characters are remembered per process, ``CACHE`` of them, and then forgotten together,
so memory is bounded and no result depends on it.

Counting (``count_tokens``) follows the merge list of a tokenizer JSON file: a heap holds the rank and position of
adjacent pairs, a linked list the living symbols, and the count is the initial symbols less the merges. The special
strings of the file count as one token each where they stand in a text.

Encoding (``encode_texts``) has two tiers: a minimal perfect hash resolves pre-tokens that are in the vocabulary as a
whole, the others are merged by heap over linked bytes. The ids are then decoded again.

Edge cases: null is the empty text, with no tokens; repeated rows each give a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.session import share_package

CACHE = 200_000
LONGEST = 48
#: Public pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_POSITION = (1 << 32) - 1


def count_merged(word: bytes, pairs: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of ``word`` when the adjacent pair of lowest rank, the leftmost of equals, is merged until none is."""
    n = left = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r << 32) | i for i in range(n - 1) if (r := pairs.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & _POSITION
        j = after[i]
        if not j or j >= n:
            continue
        k = after[j]
        if pairs.get((word[i:j], word[j:k])) != top >> 32:
            continue  # the pair that this entry described is gone
        left -= 1
        after[i], after[j] = k, 0
        before[k] = i
        if k < n and (r := pairs.get((word[i:k], word[k : after[k]]))) is not None:
            heappush(heap, (r << 32) | i)
        if (h := before[i]) >= 0 and (r := pairs.get((word[h:i], word[i:k]))) is not None:
            heappush(heap, (r << 32) | h)
    return left


def merged_pieces(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of ``word`` when the adjacent pair whose bytes have the lowest rank is merged until none has one."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r << 32) | i for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & _POSITION
        j = after[i]
        if not j or j >= n:
            continue
        k = after[j]
        if ranks.get(word[i:k]) != top >> 32:
            continue
        after[i], after[j] = k, 0
        before[k] = i
        if k < n and (r := ranks.get(word[i : after[k]])) is not None:
            heappush(heap, (r << 32) | i)
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:k])) is not None:
            heappush(heap, (r << 32) | h)
    out, i = [], 0
    while i < n:
        out.append(word[i : after[i]])
        i = after[i]
    return out


class PerfectHash:
    """A minimal perfect hash of byte strings to values, by hash and displacement.

    Keys fall into buckets; for each bucket, the fullest first, a seed is sought under which its keys take free slots.
    Buckets of one key name their slot directly (as a negative number). A look-up hashes twice and compares the key.
    """

    def __init__(self, values: dict[bytes, int]):
        n = self.size = max(1, len(values))
        groups: dict[int, list[bytes]] = {}
        for key in values:
            groups.setdefault(xxhash.xxh64_intdigest(key) % n, []).append(key)
        self.seeds = [0] * n
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        taken = bytearray(n)
        ordered = sorted(groups.items(), key=lambda g: -len(g[1]))
        free = 0
        for bucket, keys in ordered:
            if len(keys) == 1:
                while taken[free]:
                    free += 1
                slots, self.seeds[bucket] = [free], -free - 1
            else:
                seed = 1
                while True:
                    slots = [xxhash.xxh64_intdigest(k, seed) % n for k in keys]
                    if len({*slots}) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.seeds[bucket] = seed
            for slot, key in zip(slots, keys, strict=True):
                taken[slot], self.keys[slot], self.values[slot] = 1, key, values[key]

    def get(self, key: bytes) -> int | None:
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.size]
        slot = -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.size
        return self.values[slot] if self.keys[slot] == key else None


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level JSON vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.pairs = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        n = count_merged(word.encode(), self.pairs)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        get = self.__getitem__
        if self.special is None:
            return sum(map(get, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.words(p))) for p in parts)


class Encoder(dict):
    """Pre-token -> its ids in decimal, joined by one space."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = PerfectHash(self.ranks)
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> str:
        raw = word.encode()
        found = self.whole.get(raw)
        ids = str(found) if found is not None else " ".join(str(self.ranks[p]) for p in merged_pieces(raw, self.ranks))
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> str:
        return " ".join(map(self.__getitem__, self.words(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


counter = lru_cache(maxsize=2)(Counter)
encoder = lru_cache(maxsize=2)(Encoder)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path).count
    for batch in batches:
        texts = batch.column("text").fill_null("")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.binary_length(texts).cast(pa.int64()), pa.array([count(t.as_py()) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every document row, by a byte-level tokenizer JSON file."""
    share_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _count_batches(b, path), f"doc_id {kind}, n_bytes long, n_tokens long")


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    codec = encoder(path)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # The ids of a few texts at a time, so that a batch of long texts is never held several times over.
            part = batch.slice(at, 256)
            at += part.num_rows
            n, ids_out, decoded_out = [], [], []
            for text in part.column("text"):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_out.append(hashlib.sha256(ids.encode()).hexdigest() if digests else [int(i) for i in ids.split(" ")] if ids else [])
                decoded_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode("utf-8", "replace"))
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_out, kinds[0]), pa.array(decoded_out, kinds[1])], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_texts(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document row, by a rank file.

    With ``digests`` the last two are the SHA-256 of the decimal ids joined by spaces and of the decoded bytes.
    """
    share_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = "string" if digests else "array<int>"
    return rows.mapInArrow(lambda b: _encode_batches(b, path, digests), f"doc_id {kind}, n_tokens long, ids {ids}, decoded string")
