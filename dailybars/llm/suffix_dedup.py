"""Removal of repeated byte strings by suffix arrays in shards.

Every string of ``length`` bytes picks its smallest-hashed part of ``PART`` bytes
(the leftmost of equals) as its anchor, so equal strings pick equal anchors and a
document falls into *segments*: neighbouring strings with one anchor.  Segments
are counted by content.  A segment that occurs twice is repeated as a whole, and
one whose anchor occurs once cannot hold a repeated string.  What is left, and one
copy of each segment with the same anchor, goes by anchor to shards; a shard's
text is sorted by induced sorting and strings whose common prefix with a
neighbour reaches ``length`` are repeated.  Only edges of copied passages get there.

An anchor with more than ``SHARED`` different segments (the edge of a passage
that very many documents quote) is not gathered in one shard: its strings are
counted one by one by a 128-bit hash, with partial sums before the shuffle.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing
(``length`` is at least ``PART``);
repeated rows are copies of each other, so long ones lose every byte; matches
never cross documents; no rows give no rows.  Segments and strings are compared
by 128-bit hashes of their bytes, inside shards byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dailybars.llm import batches, suffix_sort
from dailybars.plans.cut import written

LENGTH = 400
PART = 100
SHARED = 2000
SHARD_BYTES = 2 << 20
SECOND_BASE = 0x2545F4914F6CDD1D


def _smallest(values, width):
    """Minimum of every ``width`` following values, by running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def segments(body, offsets, length, one, two):
    """Segments of a slice: document, first and last start, anchor hash, two content hashes."""
    n = len(body)
    if n < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
    first, second = one.prefix(body), two.prefix(body)
    at = np.arange(n - PART + 1)
    part = one.windows(first, PART)
    room = np.uint64(max(24, n.bit_length()))
    smallest = _smallest((part >> room << room) | at.astype(np.uint64), length - PART + 1)
    anchor = (smallest & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    whole = start + length <= offsets[doc + 1]
    start, anchor, doc = start[whole], anchor[whole], doc[whole]
    if not len(start):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(new[1:], len(start)) - 1
    a, b, d = start[new], start[last], doc[new]
    return [d, a - offsets[d], b - offsets[d], part[anchor[new]], one.spans(first, a, b + length), two.spans(second, a, b + length)]


def _cut(length):
    one, two = batches.Powers(), batches.Powers(SECOND_BASE)

    def cut(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("text"))
            for row, until, part, edges in batches.slices(body, offsets, 2 << 20):
                d, a, b, anchor, s1, s2 = segments(part, edges, length, one, two)
                key = batch.column("key").take(pa.array(d + row))
                yield pa.RecordBatch.from_arrays([key, pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(x.view(np.int64)) for x in (anchor, s1, s2))], names=["key", "a", "b", "anchor", "s1", "s2"])

    return cut


def _extract(length):
    """Bytes of the wanted segments of each text."""

    def extract(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = body[offsets[i]:offsets[i + 1]].tobytes()
                rows = [r | {"key": batch.column("key")[i].as_py(), "body": text[r["a"]:r["b"] + length]} for r in wanted]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.binary()), ("a", pa.int32()), ("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("body", pa.binary())]))

    return extract


def _sort_shard(length):
    def sort_shard(table: pa.Table) -> pa.Table:
        body, offsets = batches.utf8(table["body"])
        count = len(offsets) - 1
        where = offsets[:-1] + np.arange(count)  # one end letter after each segment
        end = where + np.diff(offsets)
        flat = np.zeros(len(body) + count, np.uint8)
        letters = np.ones(len(body) + count + 1, np.int16)
        at = np.arange(len(body)) + np.repeat(np.arange(count), np.diff(offsets))
        flat[at] = body
        letters[at] = body.astype(np.int16) + 2
        letters[-1] = 0
        order = suffix_sort.suffix_array(letters)[1:]
        before = np.full(len(flat), -1, np.int64)
        before[order[1:]] = order[:-1]
        long = suffix_sort.prefixes_at_least(flat, where, end, before, length)
        repeated = long.copy()
        repeated[before[long]] = True  # the neighbour shares the prefix
        single = table["n"].to_numpy() == 1
        out = [], [], []
        at, until = batches.runs(repeated, np.append(where, len(flat)))
        of = np.searchsorted(where, at, "right") - 1
        keep = single[of]
        start = table["a"].to_numpy()[of] + at - where[of]
        return pa.table({"key": table["key"].take(pa.array(of[keep])), "a": pa.array(start[keep], pa.int32()), "b": pa.array((start + until - at - 1)[keep], pa.int32())})

    return sort_shard


def _strings(length):
    """Every string of a segment as a 128-bit hash."""
    one, two = batches.Powers(), batches.Powers(SECOND_BASE)

    def strings(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("body"))
            first, second = one.prefix(body), two.prefix(body)
            number = np.diff(offsets) - length + 1
            of = np.repeat(np.arange(len(number)), number)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            at = offsets[of] + inner
            a = batch.column("a").to_numpy()[of] + inner
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), pa.array(a, pa.int32()), pa.array(batch.column("n").to_numpy()[of]), pa.array(one.spans(first, at, at + length).view(np.int64)), pa.array(two.spans(second, at, at + length).view(np.int64))], names=["key", "a", "n", "w1", "w2"])

    return strings


def _remove(length):
    def remove(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("text"))
            spans = batch.column("spans")
            edge = np.concatenate(([0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            flat = spans.flatten()
            starts, lasts = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i in range(len(batch)):
                text = body[offsets[i]:offsets[i + 1]]
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, starts[edge[i]:edge[i + 1]], 1)
                np.add.at(depth, lasts[edge[i]:edge[i + 1]] + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = text[~gone].tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | out)

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents without the bytes of strings that start more than once: doc_id, counts, ``kept`` bytes and their hash."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    identity = ("anchor", "s1", "s2")
    found = written(keyed.filter(F.octet_length("text") >= length).select("key", "text").mapInArrow(_cut(length), "key binary, a int, b int, anchor long, s1 long, s2 long")
                    .groupBy("key", "a", "b", *identity).agg(F.count(F.lit(1)).alias("n")), "segments")
    counted = found.groupBy(*identity).agg(F.sum("n").alias("n"))
    anchors = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least"))
    sortable = (F.col("different") > 1) & (F.col("least") == 1)
    status = counted.join(anchors, "anchor").filter((F.col("n") > 1) | sortable).withColumn("sort", sortable)
    marked = written(found.drop("n").join(status.select(*identity, "n", "different", "sort"), list(identity)), "repeats")
    whole = marked.filter("n > 1").select("key", "a", "b")
    # one copy of each segment to be sorted, by the text that holds it
    wanted = (marked.filter("sort").groupBy(*identity, "n", "different").agg(F.min(F.struct("key", "a", "b")).alias("at"))
              .select("at.*", *identity, "n", "different"))
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("a", "b", *identity, "n")).alias("wanted"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    bodies = texts.join(lists, "key").mapInArrow(_extract(length), "key binary, a int, anchor long, s1 long, s2 long, n long, body binary")
    crowded = anchors.filter(sortable & (F.col("different") > shared)).select("anchor", F.lit(True).alias("crowded"))
    bodies = written(bodies.join(crowded, "anchor", "left"), "segment-bytes")
    size = bodies.filter("crowded is null").agg(F.sum(F.length("body")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-size // shard_bytes))
    by_sorting = (bodies.filter("crowded is null").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
                  .groupBy("shard").applyInArrow(_sort_shard(length), "key binary, a int, b int"))
    strings = bodies.filter("crowded").select("key", "a", "n", "body").mapInArrow(_strings(length), "key binary, a int, n long, w1 long, w2 long")
    twice = strings.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1")
    by_hash = strings.filter("n = 1").join(twice, ["w1", "w2"]).select("key", "a", F.col("a").alias("b"))
    spans = whole.unionByName(by_sorting).unionByName(by_hash).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return keyed.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
