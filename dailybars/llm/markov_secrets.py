"""Secrets by two character Markov models compared by log-likelihood ratio.

The samples are labelled by rules: strings that the base patterns (assign, access,
hex) point out are random; runs of fewer than ``SHORTEST`` token characters are ordinary.  One
pass over all documents counts character pairs of both kinds, so the models rest
on the whole corpus; what comes together is one small table of pair counts.  The
random model is half learned, half uniform, so one kind of secret (such as hex)
cannot take it over.  A second pass reports the base spans and, as kind ``markov``,
every further run of at least ``SHORTEST`` token characters whose mean
log-likelihood ratio a character reaches ``RATIO``.

Added spans never overlap base spans.  Defined results: null texts are empty; texts
without spans have the hash of the empty text; rows are independent, so repeated
rows and ids are reported each on their own; without any secret in the corpus the
random model stays near uniform; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dailybars.llm import batches

SHORTEST = 16
RATIO = 0.5
SMOOTH = 20.0

# The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: 0: edge of a run, 1..: token characters.
CODE = np.zeros(256, np.int64)
CODE[list(TOKEN.encode())] = np.arange(1, len(TOKEN) + 1)
SIZE = len(TOKEN) + 1


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end of the base spans and where the secret itself begins; by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii():
        out += [("assign", *m.span(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def pairs(codes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring codes; pairs without a token character are left out."""
    both = codes[:-1] * SIZE + codes[1:]
    counts = np.bincount(both, minlength=SIZE * SIZE)
    counts[0] = 0
    return counts


def _codes(text: str) -> np.ndarray:
    return np.concatenate(([0], CODE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], [0]))


def _count(tables):
    for batch in tables:
        ordinary, random = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        body, offsets = batches.utf8(batch.column("text"))
        for row, end, part, edges in batches.slices(body, offsets, 2 << 20):
            codes = np.zeros(len(part) + (end - row) + 1, np.int64)
            codes[np.arange(len(part)) + np.repeat(np.arange(1, end - row + 1), np.diff(edges))] = CODE[part]
            start, stop = batches.runs(codes > 0, np.array([0, len(codes)]))
            for a, b in zip(start[stop - start >= SHORTEST].tolist(), stop[stop - start >= SHORTEST].tolist()):
                codes[a:b] = 0
            ordinary += pairs(codes)
        for text in batch.column("text").to_pylist():
            done = 0
            for _, _, end, begin in base_spans(text or ""):
                if begin >= done:
                    random += pairs(_codes(text[begin:end]))
                    done = end
        found = np.flatnonzero(ordinary + random)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, random[found], ordinary[found])], names=["pair", "random", "ordinary"])


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each character pair, from all documents; at most SIZE * SIZE rows reach the driver."""
    rows = docs.select("text").mapInArrow(_count, "pair long, random long, ordinary long").groupBy("pair").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).collect()
    counts = np.zeros((2, SIZE, SIZE))
    for r in rows:
        counts[:, r["pair"] // SIZE, r["pair"] % SIZE] += (r["random"], r["ordinary"])
    single = counts.sum(1) + 1  # how often a character stands at all, for characters with few neighbours seen
    single /= single.sum(1, keepdims=True)
    share = (counts + SMOOTH * single[:, None, :]) / (counts.sum(2, keepdims=True) + SMOOTH)
    return np.log(0.5 * share[0] + 0.5 / SIZE) - np.log(share[1])


def spans(text: str, ratio: np.ndarray, least: float = RATIO) -> tuple[list, list]:
    """Base spans and those the models add: (kind, start, end)."""
    base = [s[:3] for s in base_spans(text)]
    added, taken = [], sorted((a, b) for _, a, b in base)
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if any(s < b and e > a for s, e in taken[at:at + 8]):
            continue
        codes = _codes(m[0])
        if ratio[codes[:-1], codes[1:]].sum() >= least * (b - a):
            added.append(("markov", a, b))
    return base, added


def _named(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])


def _report(ratio, least):
    def report(tables):
        for batch in tables:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, added = spans(text or "", ratio, least)
                every = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append({"doc_id": doc_id, **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS[:3]},
                             "base_sha256": hashlib.sha256(_named(base).encode()).hexdigest(), "spans": _named(every)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return report


def scan(docs: DataFrame, least: float = RATIO) -> DataFrame:
    """Base counts, their hash, and all spans of every document."""
    return docs.select("doc_id", "text").mapInArrow(_report(train(docs), least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
