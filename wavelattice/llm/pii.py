"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds are found leftmost and without overlap within a kind; a proposed
span that fails its check is dropped and not tried again. Beyond them:
``iban`` (country code, the length that the country uses, and mod-97) and ``ssn`` (grouped digits
that lie outside the ranges never given out, and only next to a word that
names them).

Each span has a score: the kind's prior, raised when a checksum confirms it
and when a word that names the kind stands within ``WINDOW`` code points,
lowered when a word that names something else does. All confirmed spans are
kept whatever their score; the score is for the reader to filter by.

Offsets count code points, ends are exclusive. Null counts as empty; a text
without spans has an empty list. Extra columns are ignored by find_spans and
kept by redact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
WINDOW = 48

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, as matches end with one; so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_CHAR = re.compile(r"\x20?[A-Z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Prior score of a confirmed span, and words that speak for a kind or against all kinds.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|login|client|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer|konto|bic)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|order|invoice|isbn|serial|example|build|release)\b", re.I)


def luhn(digits: str) -> bool:
    """True for a digit string whose Luhn sum is divisible by ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True for a space-free IBAN whose rearranged number leaves 1 modulo 97."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(s: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", s)) <= 15


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, in one piece or with single spaces, that leave 1 modulo 97."""
    done = 0
    for m in _IBAN.finditer(text):
        size, end = IBAN_LENGTHS.get(m[1], 0), m.end()
        if m.start() < done or not size:
            continue
        for _ in range(size - 4):
            c = _IBAN_CHAR.match(text, end)
            if not c:
                break
            end = c.end()
        else:
            # A following space ends it, whatever comes next; a letter or digit that touches it does not.
            if not (end < len(text) and text[end].isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                done = end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, looked for only around each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _LOCAL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    score = PRIOR[kind] + (0.15 if kind in ("card", "iban") else 0) + (0.2 if FOR[kind].search(around) else 0)
    return round(min(1.0, max(0.0, score - (0.3 if AGAINST.search(around) else 0))), 2)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all personal data in a text, by start, then kind as in KINDS."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, check in (("ip", _IP, _ip), ("card", _CARD, _card)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if check(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if _phone(m[0])]
        out += [("iban", *s) for s in _ibans(text)]
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            near = text[max(0, m.start() - WINDOW) : m.end() + WINDOW]
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and FOR["ssn"].search(near):
                out.append(("ssn", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [(*s, _score(s[0], text, s[1], s[2])) for s in out]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(struct))], names=["doc_id", "spans"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for kind, start, end, _ in spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text column replaced; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if t is None else redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text, from find_spans."""
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:4]))
    text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))
