"""Text columns as flat byte arrays, in bounded slices.

The operators run as ``mapInArrow`` tasks.  A text column arrives as one UTF-8
buffer with offsets, so numpy can work on all documents of a slice at once and
no Python string is made per document or word.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and would keep it beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def releasing(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the work on one has freed is given back before the next."""
    for batch in tables:
        yield batch
        del batch
        release()


BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(body: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes and at most ``rows`` rows: (first row, end row, bytes, offsets)."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield row, end, body[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that stays in one document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1], out=first[1:])
    edges = offsets[:-1]
    first[edges[edges < len(inside)]] = True
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(inside))
    keep = inside[at]
    return at[keep], ends[keep]


_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A seeded bijection of 64-bit words that scatters them."""
    x = x ^ np.uint64(seed * _ODD & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, body: np.ndarray) -> np.ndarray:
        """Prefix sums of (byte + 1) * base**i; one more than bytes."""
        self.grow(len(body) + 1)
        out = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.up[:len(body)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of bytes[start:end] that depends on their content and number."""
        raw = (prefix[end] - prefix[start]) * self.down[start]
        return mix(raw ^ mix((end - start).astype(np.uint64)))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The same hash of every ``width`` following bytes."""
        raw = prefix[width:] - prefix[:-width]
        raw *= self.down[:len(raw)]
        return mix(raw ^ mix(np.array([width], np.uint64)))


def row_numbers(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document each position lies in; empty documents hold none."""
    return np.searchsorted(offsets, at, "right") - 1


def words(body: np.ndarray, offsets: np.ndarray, powers: Powers, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a slice: start, end, document, hash."""
    low = LOWER[body]
    start, end = runs(~blank[low], offsets)
    return start, end, row_numbers(offsets, start), powers.spans(powers.prefix(low), start, end)


def grams(hashes: np.ndarray, doc: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k following words of one document: (hash, document, number of the first word).

    With ``short``, a document of fewer than k words has one gram of all its words.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(doc, doc, "left")
    last = np.searchsorted(doc, doc, "right")
    place = np.arange(n)
    take = np.minimum(k, last - place)
    keep = take == k
    if short:
        keep |= place == first
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            here = np.minimum(place + i, n - 1)
            out = np.where(i < take, mix(out * np.uint64(3) ^ hashes[here], i + 1), out)
    return out[keep], doc[keep], (place - first)[keep]


def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each ``block`` of a batch as one compressed Arrow stream: a dense form to shuffle texts in."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in tables:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        rows = pa.Table.from_batches([batch]).drop_columns(["block"]).take(pa.array(order))
        ids, first = np.unique(block[order], return_index=True)
        packed = []
        for i, j in zip(first, [*first[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows.slice(i, j - i).combine_chunks())
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])


def unpack(table: pa.Table) -> pa.Table:
    """The rows that ``pack`` put together for one block."""
    return pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["packed"])
