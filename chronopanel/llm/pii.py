"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are always kept. Added kinds (iban, national
id) count only if their checksum holds or the words around lift the score to
the threshold. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import with_text_ids

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match of either takes all of a run of digits, so none can start within one: looking behind saves the retries.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")

#: Words near a span that make it likelier, by kind.
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "correo", "kontakt", "courriel"},
    "ip": {"ip", "host", "server", "address", "adresse"},
    "card": {"card", "visa", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "national_id": {"ssn", "social", "security", "id", "insurance", "national"},
}
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "national_id": 0.3}
LIFT, WINDOW, THRESHOLD = 0.3, 60, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 13616: the rearranged letters and digits leave 1 by 97."""
    text = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in text)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its @: what precedes it has no @, so each @ has one start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind and start."""
    found: list[tuple[str, int, int]] = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := g.lstrip("0")) < 4 and int(x or 0) <= 255 for g in m.groups())]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
        for m in _IBAN.finditer(text):
            if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x):
                found.append(("iban", *m.span()))
        if "-" in text:
            found += [("national_id", *m.span()) for m in _NATIONAL.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    out = []
    for kind, start, end in found:
        near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start]) + _WORD.findall(text[end : end + WINDOW])}
        score = min(1.0, BASE[kind] + LIFT * bool(near & CONTEXT[kind]))
        if score >= threshold or kind in KINDS[:4]:
            out.append((kind, start, end, round(score, 3)))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans) for every row; a null or empty text has no spans. Rows are independent, repeated ones give equal rows; a null id is kept, other columns are ignored."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t, threshold)] if t else [] for t in part[text_col]]
            yield pd.DataFrame({id_col: part[id_col], "spans": found})

    return with_text_ids(docs.select(id_col, text_col), run, id_col, f"spans {SPANS}")


def redact(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by <kind>; overlapping spans merge under the first."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
