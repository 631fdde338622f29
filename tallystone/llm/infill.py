"""Fill-in-middle transformation over a sparse checkpoint index.

A text is cut at two of its units (code points, or the matches of a bytes pattern such as words with their blanks) into
prefix, middle and suffix. One pass over the UTF-8 bytes counts the units and records, for every ``EVERY``-th of them,
its byte and its code-point offset; a cut is then found by binary search among these checkpoints and a short rescan,
so a very long text is neither decoded nor indexed unit by unit. The pass walks blocks of ``BLOCK`` bytes, so its
memory is the text and one checkpoint for every ``EVERY`` units.

The cuts, the form (``psm``, ``spm`` or ``plain``) and with them the whole output depend on doc_id and text alone: they
are the same wherever and however often a task runs.

Edge cases: null and empty texts have no units and stay plain and empty; texts that contain a sentinel stay plain; both
cuts may coincide or lie at an end, which gives empty parts; what stands before the first match of a pattern belongs to
the prefix or, with cuts at 0, to the part that begins there; a null doc_id is hashed as the empty string; repeated rows
each give a row with the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.textbatch import slices, text_bytes
from tallystone.session import share_package

SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are cut, and of these per cent in suffix-first form.
CUT_RATE = 90
SPM_RATE = 20
EVERY = 512
BLOCK = 1 << 16


def _leads(block: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin a code point."""
    return np.flatnonzero((block & 0xC0) != 0x80)


@dataclass
class Checkpoints:
    """How many units a text has, and number, byte and code-point offset of every so-many-th of them and of the end."""

    data: np.ndarray
    n: int
    units: np.ndarray
    bytes: np.ndarray
    points: np.ndarray
    pattern: regex.Pattern | None

    def locate(self, cut: int) -> tuple[int, int]:
        """Byte and code-point offset of unit ``cut``, or of the end for the number of units."""
        i = int(np.searchsorted(self.units, cut, side="right")) - 1
        left, at, point = cut - int(self.units[i]), int(self.bytes[i]), int(self.points[i])
        if not left:
            return at, point
        until = int(self.bytes[i + 1])
        if self.pattern is None:
            return at + int(_leads(self.data[at:until])[left]), point + left
        found = next(islice(self.pattern.finditer(self.data, at), left, None)).start()
        return found, point + len(_leads(self.data[at:found]))


def checkpoints(data: np.ndarray, pattern: regex.Pattern | None = None, every: int = EVERY) -> Checkpoints:
    """The index of a text's UTF-8 bytes; units are code points or the pattern's matches from left to right."""
    units, places, points = [], [], []
    n = point = 0
    if pattern is None:
        for start in range(0, len(data), BLOCK):
            leads = _leads(data[start : start + BLOCK])
            marks = range(-n % every, len(leads), every)
            units += [n + m for m in marks]
            places += (leads[marks.start :: every] + start).tolist()
            n += len(leads)
        points, point = units.copy(), n
    else:
        last = 0
        for n, match in enumerate(pattern.finditer(data), 1):  # noqa: B007
            if (n - 1) % every == 0:
                point += len(_leads(data[last : match.start()]))
                last = match.start()
                units.append(n - 1)
                places.append(last)
                points.append(point)
        point += len(_leads(data[last:]))
    if not n:
        units, places, points = [0], [0], [0]
    return Checkpoints(data, n, np.array([*units, n]), np.array([*places, len(data)]), np.array([*points, point]), pattern)


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers: the first eight-digit groups of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut_batches(batches: Iterator[pa.RecordBatch], unit: bytes | None, every: int, cut_rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    pattern = regex.compile(unit) if unit else None
    p, s, m = (x.encode() for x in sentinels)
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            drawn = zip(*(batch.column(f"h{i}").to_pylist() for i in range(1, 5)), strict=True)
            ns, forms, prefixes, middles, outputs = [], [], [], [], []
            for (h1, h2, h3, h4), start, end in zip(drawn, offsets[:-1], offsets[1:], strict=True):
                index = checkpoints(data[start:end], pattern, every)
                text = data[start:end].tobytes()
                ns.append(index.n)
                if not text or p in text or s in text or m in text or h3 % 100 >= cut_rate:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
                (a, a_point), (b, b_point) = index.locate(low), index.locate(high)
                suffix_first = h4 % 100 < spm_rate
                forms.append("spm" if suffix_first else "psm")
                prefixes.append(a_point)
                middles.append(b_point - a_point)
                outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if suffix_first else (p, text[:a], s, text[b:], m, text[a:b])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            made = [pa.array(x, k) for x, k in zip((ns, forms, prefixes, middles), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(
    docs: DataFrame, seed: int = 1, unit: bytes | None = None, every: int = EVERY, cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain) and output of every row.

    ``unit`` is a bytes pattern whose matches are the units, code points without one; ``sentinels`` mark prefix, suffix
    and middle, none of them holding or overlapping another or itself.
    """
    share_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    return rows.mapInArrow(
        lambda b: _cut_batches(b, unit, every, cut_rate, spm_rate, sentinels), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from: its parts between the sentinels, put in order."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
