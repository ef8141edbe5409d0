"""Finding benchmark passages in documents by the q-gram lemma.

Text and items are compared as lower-cased words with one blank between them, in
bytes.  An item of m bytes found with at most e edits shares at least
m - Q + 1 - Q * e q-grams with the place where it stands, on diagonals (offset in
the document less offset in the item) that differ by at most e.  So shared q-grams
are counted in overlapping bands of e + 1 diagonals; bands that reach the bound
are kept and verified by an alignment limited to the band.  e is ``EDITS`` times m,
rounded up, or what the lemma still allows for a short item.

Documents are read once and never shuffled.  The q-grams of the items go to the
tasks; items are taken in parts of at most ``PART_BYTES`` on average, with one pass
over the documents for each part, so what is sent has a bound however many items
there are.

Defined results: null and blank texts and items match nothing; items of fewer than
Q bytes are not looked for, as they stand everywhere; a null or repeated doc_id or
item_id is reported row by row; an item found at several places of a document
gives one row for each place that does not overlap a better one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dailybars.llm import batches

Q = 12
EDITS = 0.05
PART_BYTES = 4 << 20
FILTER_BITS = 22
END = 0x0A


def plain(body, offsets):
    """Lower-cased words with one blank between them, an end byte after each row; where rows start."""
    low = batches.LOWER[body]
    start, end = batches.runs(~batches.BLANK[low], offsets)
    doc = batches.row_numbers(offsets, start)
    length, rows = end - start, len(offsets) - 1
    size = np.bincount(doc, weights=length + 1, minlength=rows).astype(np.int64)
    size[size == 0] = 1
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.full(begin[-1], 0x20, np.uint8)
    out[begin[1:] - 1] = END
    before = np.cumsum(length + 1) - length - 1
    first = np.searchsorted(doc, doc, "left")
    at = begin[doc] + before - before[first] if len(doc) else before
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + inner] = low[np.repeat(start, length) + inner]
    return out, begin


def align(item: np.ndarray, text: np.ndarray, most: int, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits of ``item`` against a stretch of ``text`` and its end (``anchored``: the stretch starts at 0).

    Row by row; more than ``most`` edits are returned as most + 1.
    """
    n = len(text)
    place = np.arange(n + 1)
    row = place.copy() if anchored else np.zeros(n + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """Q-grams of some items: sorted hashes, and where they stand."""

    def __init__(self, ids: list, texts: list, q: int = Q, edits: float = EDITS):
        body, offsets = batches.utf8(pa.array(texts, pa.string()))
        stream, begin = plain(body, offsets)
        self.q, self.ids = q, ids
        self.text = [stream[a:b - 1] for a, b in zip(begin[:-1], begin[1:])]
        size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.minimum(np.ceil(edits * size), np.maximum(size - q, 0) // q).astype(np.int64)
        self.bound = size - q + 1 - q * self.edits
        self.size = size
        at = np.arange(max(len(stream) - q + 1, 0))
        of = np.repeat(np.arange(len(size)), np.diff(begin))[:len(at)]
        keep = at + q <= begin[of + 1] - 1
        at, of = at[keep], of[keep]
        powers = batches.Powers()
        hashes = powers.spans(powers.prefix(stream), at, at + q)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.first = np.unique(hashes[order], return_index=True)
        self.until = np.append(self.first[1:], len(order))
        self.of, self.at = of[order], (at - begin[of])[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.hash >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, stream, begin, powers):
        """(row, item, start, end, edits) of the places where items stand in a slice."""
        q = self.q
        if len(stream) < q or not len(self.hash):
            return []
        prefix = powers.prefix(stream)
        hashes = batches.mix(((prefix[q:] - prefix[:-q]) * powers.down[:len(stream) - q + 1]) ^ batches.mix(np.full(1, q, np.uint64)))
        hit = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        slot = np.minimum(np.searchsorted(self.hash, hashes[hit]), len(self.hash) - 1)
        good = self.hash[slot] == hashes[hit]
        hit, slot = hit[good], slot[good]
        many = self.until[slot] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        item, row = self.of[entry], np.repeat(np.searchsorted(begin, hit, "right") - 1, many)
        diagonal = np.repeat(hit, many) - self.at[entry]
        band = diagonal // (self.edits[item] + 1)
        place = np.stack((np.tile(row, 2), np.tile(item, 2), np.concatenate((band, band - 1))))
        order = np.lexsort(place[::-1])
        place = place[:, order]
        new = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(0)))) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(order)))
        place = place[:, new]
        keep = counts >= self.bound[place[1]]
        found = {}
        for r, i, b in place[:, keep].T.tolist():
            e, item_text = int(self.edits[i]), self.text[i]
            low = max(b * (e + 1) - e, int(begin[r]))
            high = min((b + 2) * (e + 1) + len(item_text) + e, int(begin[r + 1]) - 1)
            part = stream[low:high]
            edits, end = align(item_text, part, e)
            if edits <= e:
                back = align(item_text[::-1], part[:end][::-1], e, anchored=True)[1]
                found.setdefault((r, i), set()).add((edits, low + end - back - int(begin[r]), low + end - int(begin[r])))
        out = []
        for (r, i), places in sorted(found.items()):
            taken = []
            for edits, start, end in sorted(places):
                if all(end <= s or start >= t for s, t in taken):
                    taken.append((start, end))
                    words = stream[int(begin[r]):int(begin[r]) + start]
                    first = int(np.count_nonzero(words == 0x20))
                    out.append((r, i, first, first + int(np.count_nonzero(stream[int(begin[r]) + start:int(begin[r]) + end - 1] == 0x20)), edits))
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])


def _search(items: Items):
    powers = batches.Powers()

    def search(tables):
        for batch in batches.releasing(tables):
            body, offsets = batches.utf8(batch.column("text"))
            ids = batch.column("doc_id")
            for row, _, part, edges in batches.slices(body, offsets, 1 << 20):
                rows = [{"doc_id": ids[row + r].as_py(), "item_id": items.ids[i], "first_word": a, "last_word": b, "edits": e, "similarity": 1 - e / max(1, int(items.size[i]))}
                        for r, i, a, b, e in items.find(*plain(part, edges), powers)]
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return search


def _parts(benchmark: DataFrame, q: int, edits: float, part_bytes: int):
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(1, math.ceil(size / part_bytes))
    dealt = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    for k in range(parts):
        rows = dealt.filter(F.col("part") == k).collect()  # part_bytes on average
        yield Items([r["item_id"] for r in rows], [r["text"] or "" for r in rows], q, edits)


def passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Places of benchmark items in documents: doc_id, item_id, first and last word, edits, similarity."""
    out = None
    for items in _parts(benchmark, q, edits, part_bytes):
        found = docs.select("doc_id", "text").mapInArrow(_search(items), "doc_id long, item_id long, first_word long, last_word long, edits long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def _without(items: Items, text: int):
    powers = batches.Powers()

    def without(tables):
        for batch in batches.releasing(tables):
            body, offsets = batches.utf8(batch.column(text))
            for row, end, part, edges in batches.slices(body, offsets, 1 << 18):
                keep = np.ones(end - row, bool)
                for r, *_ in items.find(*plain(part, edges), powers):
                    keep[r] = False
                yield batch.slice(row, end - row).filter(pa.array(keep))

    return without


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands; one narrow pass for each part of the items."""
    for items in _parts(benchmark, q, edits, part_bytes):
        docs = docs.mapInArrow(_without(items, docs.columns.index("text")), docs.schema)
    return docs
