"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. A small
parser for the anchor's kind then expands from it to both sides and validates what it finds:

* email: the local part is read leftwards from the at-sign, the dotted domain rightwards;
* ip: four dotted numbers from a digit that begins a run, each at most 255;
* card: digits with single spaces or hyphens between, 12 to 19 of them, passing Luhn;
* phone: from a plus sign, 9 to 15 digits;
* url: a scheme with user information before the host (other addresses are not personal);
* account: an identifier cue (IBAN, SSN, account number) followed by a number that passes the cue's own check.

The first four give exactly the leftmost non-overlapping matches of their patterns (what fails validation is consumed
and dropped); each kind has its own cursor.

Edge cases: null is the empty text, with no spans; repeated rows each give a row; an empty table gives no rows; other
columns are ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.session import share_package

KINDS = ["email", "ip", "card", "phone", "url", "account"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER_HOST = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_CUES = {"iban": re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})"), "ssn": re.compile(r"[\s:#.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), "account": re.compile(r"(?:\s+(?:no|nr|number))?[\s:#.]{1,4}([0-9]{6,17})(?![0-9-])")}


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, (0, digit))
    found.add_word("@", (1, "@"))
    found.add_word("+", (2, "+"))
    found.add_word("://", (3, "://"))
    for cue in _CUES:
        for word in (cue, cue.upper(), cue.capitalize()):
            found.add_word(word, (4, cue))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def passes_mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _account_ok(cue: str, value: str) -> bool:
    if cue == "iban":
        return 15 <= len(value) <= 34 and passes_mod97(value)
    if cue == "ssn":
        area, group, serial = value.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return True


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, index in KINDS, end)."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (what, key) in _anchors().iter(text):
        if what == 0:
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and passes_luhn(digits):
                    out.append((last, 2, card_end))
            if last >= ip_end and not (last and "0" <= text[last - 1] <= "9") and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p := part.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for part in m[0].split(".")):
                    out.append((last, 1, ip_end))
        elif what == 1:
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif what == 2:
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((last, 3, phone_end))
        elif what == 3:
            start = last - 2
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < last - 2 and text[start].isalpha() and (m := _USER_HOST.match(text, last + 1)):
                url_end = m.end()
                out.append((start, 4, url_end))
        elif last >= account_end and (m := _CUES[key].match(text, last + 1)):
            value = m[1].replace(" ", "")
            while key == "iban" and len(value) > 15 and not _account_ok(key, value):
                value = value[:-1]  # letters of the next word may have been read along
            if _account_ok(key, value):
                end, left = m.start(1), len(value)
                while left:
                    left -= text[end] != " "
                    end += 1
                account_end = end
                out.append((m.start(1), 5, end))
    out.sort()
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [personal_spans(t.as_py() or "") for t in batch.column("text")]
        base = [[s for s in row if s[1] < 4] for row in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array([sum(s[1] == k for s in row) for row in base], pa.int64()) for k in range(4)),
                pa.array([hashlib.sha256(spans_text(row).encode()).hexdigest() for row in base]),
                pa.array([spans_text(row) for row in spans], pa.string()),
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined) of every row."""
    share_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    return rows.mapInArrow(_span_batches, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
