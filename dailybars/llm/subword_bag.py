"""Toxicity scores from averaged subword vectors and a linear softmax.

A document is the bag of its lower-cased words, a word the bag of its byte n-grams, blanks at both ends
included, so an unseen misspelling shares most vectors with the word it stands
for.  N-grams are hashed to ``CELLS`` vectors; those in fewer than ``LEAST`` sample
documents have none.  The vectors of a document are averaged and go through a
softmax over two labels; vectors and softmax are learned together by stochastic
gradient steps in numpy.

The model is fitted on a bounded sample of labelled rows: of each label the
``SAMPLE`` documents first in the order of md5(doc_id), which is a random sample
that does not depend on how the table is stored.  ``SAMPLE`` is a parameter; with
fewer labelled rows all are used.  The bias is then moved from the balance of the
sample to the share of the labels among all labelled training rows.  Scores of
all documents come from a table of one number per cell, as the difference of the
two logits is linear in the cells.

Defined results: null and blank texts have no vectors and get the share of label
1; a null doc_id counts as held out; repeated rows are scored alike; documents
without label are scored like others; several labels of one document count one by
one; without labelled rows of both kinds every score is the share of label 1
(0.0 if there is none).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dailybars.llm import batches
from dailybars.plans.cut import written

CELLS = 1 << 18
SIZES = (3, 4, 5, 6, 7)
WIDTH = 8
SAMPLE = 1500
STEPS = 1200
BATCH = 32
RATE = 1.0
LEAST = 6
SCALE = 300.0
SEED = 7
TASKS = 16
SLICE = 1 << 17


def subwords(body, offsets, sizes=SIZES, cells=CELLS):
    """Cells and document of every n-gram of the words of a slice."""
    low = batches.LOWER[body]
    start, end = batches.runs(~batches.BLANK[low], offsets)
    doc = batches.row_numbers(offsets, start)
    length = end - start
    at = np.cumsum(length + 2) - length - 1  # one blank before and after each word
    stream = np.full(int((length + 2).sum()), 0x20, np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    stream[np.repeat(at, length) + inner] = low[np.repeat(start, length) + inner]
    of = np.repeat(doc, length + 2)
    room = np.repeat(at + length + 1, length + 2) - np.arange(len(stream))  # bytes up to the word's last blank
    found, owner = [], []
    key = stream
    for n in range(2, max(sizes, default=0) + 1):
        key = (key[:-1] << np.uint64(8)) | stream[n - 1:] if len(key) else key
        if n in sizes:
            fits = room[:len(key)] >= n
            found.append((batches.mix(key[fits], n) % np.uint64(cells)).astype(np.int32))
            owner.append(of[:len(key)][fits])
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Model:
    """One number per cell and a bias: the difference of the logits of label 1 and label 0; unknown cells have NaN."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = np.nan_to_num(weights), bias, ~np.isnan(weights)

    def score(self, cells: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        total = np.bincount(doc, weights=self.weights[cells], minlength=rows)
        number = np.bincount(doc, weights=self.known[cells], minlength=rows)
        logit = total / np.maximum(number, 1) + self.bias
        return 1 / (1 + np.exp(np.clip(-logit, -700, 700)))


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def bags(body, offsets, sizes=SIZES, cells=CELLS):
    """Distinct cells of every document of a slice and how often it has each, both as 32-bit numbers."""
    found, of = subwords(body, offsets, sizes, cells)
    key, times = np.unique(of * cells + found, return_counts=True)
    edges = np.searchsorted(key, np.arange(1, len(offsets) - 1) * cells)
    return list(zip(np.split((key % cells).astype(np.int32), edges), np.split(times.astype(np.int32), edges))) if len(offsets) > 1 else []


def fit(texts: list, labels: list, prior: float, cells: int = CELLS, **options) -> Model:
    """A model fitted on whole texts (see ``fit_bags``)."""
    body, offsets = batches.utf8(pa.array(texts, pa.string()))
    held = [b for _, _, part, edges in batches.slices(body, offsets, 1 << 20) for b in bags(part, edges, cells=cells)]
    return fit_bags(held, labels, prior, cells=cells, **options)


def fit_bags(held: list, labels: list, prior: float, steps: int = STEPS, width: int = WIDTH, rate: float = RATE, seed: int = SEED, cells: int = CELLS) -> Model:
    """Vectors and softmax learned jointly by gradient steps on small batches of bags (cells and their counts)."""
    prior = min(max(prior, 0.0), 1.0)
    edge = 1e-9
    log_prior = math.log((prior + edge) / (1 - prior + edge))
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.full(cells, np.nan), log_prior)
    held_by = np.zeros(cells, np.int64)
    for cell, _ in held:
        held_by[cell] += 1
    common = held_by >= LEAST
    held = [(c, n) if common[c].all() else (c[common[c]], n[common[c]]) for c, n in held]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.001, (cells, width)).astype(np.float32)
    top, bias = rng.normal(0, 1, (width, 2)).astype(np.float32), np.zeros(2, np.float32)
    done, per_epoch = 0, -(-len(y) // BATCH)
    steps = per_epoch * -(-steps // per_epoch)
    many, used = np.array([len(c) for c, _ in held]), np.array([n.sum() for _, n in held], np.float32)
    for _ in range(steps // per_epoch):
        for rows in np.array_split(rng.permutation(len(y)), per_epoch):
            now = rate * (1 - done / steps)
            done += 1
            rows = rows[used[rows] > 0]
            if not len(rows):
                continue
            flat, times = (np.concatenate([held[i][k] for i in rows]) for k in (0, 1))
            times = times.astype(np.float32)
            edges = np.cumsum(many[rows]) - many[rows]
            mean = np.add.reduceat(vectors[flat] * times[:, None], edges, axis=0) / used[rows, None]
            scaled = mean * SCALE
            error = _softmax(scaled @ top + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = (error @ top.T * SCALE / used[rows, None]).astype(np.float32)
            own = np.repeat(np.arange(len(rows)), many[rows])
            cell, at = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(at, weights=back[own, k] * times, minlength=len(cell)) for k in range(width)], 1).astype(np.float32)
            vectors[cell] -= now * step
            top -= (now / SCALE * (scaled.T @ error)).astype(np.float32)
            bias -= (now * error.sum(0)).astype(np.float32)
    share = y.mean()
    moved = float(bias[1] - bias[0]) + log_prior - math.log(share / (1 - share))
    return Model(np.where(common, (vectors @ (top[:, 1] - top[:, 0])).astype(float) * SCALE, np.nan), moved)


def _scorer(model: Model):
    """A UDF over the text column alone; the other columns stay in the JVM."""
    def scores(text: pa.Array) -> pa.Array:
        body, offsets = batches.utf8(text)
        out = []
        for row, end, part, edges in batches.slices(body, offsets, SLICE):
            found, of = subwords(part, edges, cells=len(model.weights))
            out.append(model.score(found, of, end - row))
        batches.release()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(scores, T.DoubleType())


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with their score as ``name`` (a column of that name is replaced)."""
    return docs.withColumn(name, _scorer(model)("text"))


def held_out(doc_id, fold: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % fold == 0


def _sampled_bags(tables):
    """Bags of the texts of a batch as bytes; texts stay on the executors."""
    for batch in batches.releasing(tables):
        body, offsets = batches.utf8(batch.column("text"))
        held = [b for _, _, part, edges in batches.slices(body, offsets, SLICE) for b in bags(part, edges)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), batch.column("place"), *(pa.array([b[k].tobytes() for b in held], pa.binary()) for k in (0, 1))],
            names=["toxic", "place", "cells", "times"])


def _held_by(tables):
    """How many documents of a task hold each cell, as one compressed array."""
    total = np.zeros(CELLS, np.int32)
    for batch in batches.releasing(tables):
        for cells in batch.column("cells"):
            total[np.frombuffer(cells.as_buffer(), np.int32)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([pa.Codec("zstd").compress(total.tobytes()).to_pybytes()], pa.binary())], names=["held"])


def _common_bags(common):
    """Bags without rare cells, compressed: steps from cell to cell, then counts."""
    def keep(tables):
        codec = pa.Codec("zstd")
        for batch in batches.releasing(tables):
            made = []
            for cells, times in zip(batch.column("cells"), batch.column("times")):
                cells, times = np.frombuffer(cells.as_buffer(), np.int32), np.frombuffer(times.as_buffer(), np.int32)
                kept = common[cells]
                made.append(codec.compress(np.concatenate([np.diff(cells[kept], prepend=np.int32(0)), times[kept]]).tobytes()).to_pybytes())
            n = pa.array([int(common[np.frombuffer(c.as_buffer(), np.int32)].sum()) for c in batch.column("cells")], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("place"), n, pa.array(made, pa.binary())], names=["toxic", "place", "n", "bag"])

    return keep


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the training rows of ``labels`` (doc_id, toxic); of documents that repeat an id the first text counts.

    The driver gets the cells that ``LEAST`` documents of the sample hold, never a text.
    """
    known = labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    total, ones = known.agg(F.count("toxic"), F.sum("toxic")).first()
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample).withColumn("nth", F.monotonically_increasing_id()) for k in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # at most 2 * sample rows
    single = rows.groupBy("doc_id", "toxic", "nth").agg(F.min("text").alias("text")).withColumn("place", F.concat_ws(":", order, "toxic", "nth"))
    held = written(single.select("toxic", "place", "text").mapInArrow(_sampled_bags, "toxic int, place string, cells binary, times binary"), "bags")
    codec, held_by = pa.Codec("zstd"), np.zeros(CELLS, np.int64)
    for r in held.select("cells").coalesce(TASKS).mapInArrow(_held_by, "held binary").toLocalIterator():
        held_by += np.frombuffer(codec.decompress(r["held"], CELLS * 4), np.int32)
    rows = held.mapInArrow(_common_bags(held_by >= LEAST), "toxic int, place string, n int, bag binary").orderBy("place")
    kept, y = [], []
    for r in rows.toLocalIterator():  # one document after the other
        x = np.frombuffer(codec.decompress(r["bag"], r["n"] * 8), np.int32)
        kept.append((np.cumsum(x[:r["n"]], dtype=np.int32), x[r["n"]:].copy()))
        y.append(r["toxic"])
    return fit_bags(kept, y, (ones or 0) / total if total else 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, sample)
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return scored(marked, model).drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
