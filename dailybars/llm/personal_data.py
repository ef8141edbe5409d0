"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Base kinds (email, ip, card, phone) are reported whenever their own rule holds; the
score says how sure a span is: a start value for the kind, more where a checksum
holds, more or less by words in the ``NEAR`` characters before it.  The method adds
IBANs that have their country's length and pass the modulo-97 rule (capitals and
digits may follow as further words), and national numbers (3-2-4 digits) where a
context word lifts them over ``LEAST``.  Added spans may not overlap others.

Texts are read whole; no pattern goes back over a long run of its own characters.
Defined results: null texts are empty; texts without spans have empty lists and the
hash of the empty text; rows are independent, so repeated rows and ids are reported
each on their own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from dailybars.llm import batches

NEAR = 60
LEAST = 0.6
ROWS = 500

# Kinds in their order, start scores and context words.
KINDS = ("email", "ip", "card", "phone", "iban", "national")
START = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.4, "iban": 0.5, "national": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}
FOR = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "national": ("ssn", "social", "security", "national"),
}
AGAINST = ("example", "version", "isbn", "order", "invoice")

# IBAN lengths of the SWIFT registry.
LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text):
    """Candidates cut at the length of their country; of other countries the longest part that passes and ends with a word."""
    at = 0
    while match := _IBAN.search(text, at):
        start, end = match.span()
        at = start + 1
        length = LENGTHS.get(text[start:start + 2])
        while end - start >= 15:
            size = end - start - text.count(" ", start, end)
            if size < (length or 15):
                break
            if text[end - 1] != " " and text[end:end + 1] not in _ALNUM and length in (None, size) and mod97(text[start:end].replace(" ", "")):
                yield start, end
                at = end
                break
            end -= 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(v := p.lstrip("0")) < 4 and int(v or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def confidence(text: str, kind: str, start: int) -> float:
    near = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
    score = START[kind] + CHECKED.get(kind, 0) + 0.4 * any(w in near for w in FOR[kind]) - 0.2 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 3)


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and those the method adds."""
    base = base_spans(text)
    more = [("iban", a, b) for a, b in _ibans(text)]
    more += [("national", *m.span()) for m in _NATIONAL.finditer(text) if confidence(text, "national", m.start()) >= LEAST]
    taken, added = [(a, b) for _, a, b in base], []
    for kind, a, b in more:
        if all(b <= s or a >= e for s, e in taken):
            added.append((kind, a, b))
            taken.append((a, b))
    return base, added


def redact(text: str) -> str:
    """The text with every span replaced by the name of its kind."""
    base, added = spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _named(spans_):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans_)


def _report(tables):
    for batch in batches.releasing(tables):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base, added = spans(text or "")
            count = {k: sum(s[0] == k for s in base) for k in KINDS[:4]}
            rows.append({"doc_id": doc_id, **{f"n_{k}": n for k, n in count.items()}, "base_sha256": hashlib.sha256(_named(base).encode()).hexdigest(), "spans": _named(base + added),
                         "scores": [confidence(text, k, a) for k, a, _ in base + added]})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))])


def report(docs: DataFrame) -> DataFrame:
    """Spans and scores of every document."""
    return docs.select("doc_id", "text").mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def _redact(position):
    def run(tables):
        for batch in batches.releasing(tables):
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([None if t is None else redact(t) for t in part.column(position).to_pylist()], batch.schema.field(position).type)
                yield part.set_column(position, batch.schema.field(position), texts)

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the spans in ``text`` replaced by their kinds; null texts stay null."""
    return docs.mapInArrow(_redact(docs.columns.index("text")), docs.schema)
