"""Language of texts from a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 bytes in windows of ``WINDOW``, all of it.  One gated
recurrent unit reads a window forwards, another backwards, and a softmax over both
states labels every position; a document's probabilities are the mean over its
positions.  The network is trained in numpy by backpropagation through time (Adam
steps on the mean cross-entropy of all positions of a batch of windows).

It is fitted on a bounded sample: of each language, one window of each of the
``SAMPLE`` training documents first in the order of md5(doc_id), at a place in the
text that depends on doc_id.  With more than ``LANGUAGES`` languages the most
frequent ones are learned.  Both are parameters; at most SAMPLE * LANGUAGES *
WINDOW bytes (20 MB) reach the driver.

Gates and states use x / (1 + |x|) where a textbook unit has the logistic function
and tanh.  Arrays lie feature by feature ([features, windows]), so each step of many windows
is a few products and elementwise operations over contiguous rows.

Defined results: a null text, an empty one and one without a letter are ``und``
with score 0; so is every text if no language could be learned; texts of any
length are read whole; a null doc_id counts as remainder 0; repeated rows are
labelled alike; a tie goes to the language first by name; no rows give no rows;
other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.llm import batches

WINDOW = 128
WIDTH = 10
SAMPLE = 400
LANGUAGES = 400
EPOCHS = 10
BATCH = 96
RATE = 0.02
SEED = 11
TOGETHER = 2048
SLICE = 4 << 20


class Network:
    """Tables of input gates by byte, recurrent weights and outputs; index 0 reads forwards, 1 backwards."""

    def __init__(self, languages: list[str], width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.languages, self.width = languages, width
        self.weights = [draw(0.3, 3 * width, 256), draw(0.3, 3 * width, 256), draw(width ** -0.5 / 2, 3 * width, width), draw(width ** -0.5 / 2, 3 * width, width),
                        draw(0.2, len(languages), width), draw(0.2, len(languages), width), np.zeros((len(languages), 1), np.float32)]

    def states(self, way: int, seq: np.ndarray, keep: bool = False):
        """States of a direction after each byte of ``seq`` [steps, windows]; with ``keep`` also what the way back needs."""
        table, turn, k = self.weights[way], self.weights[2 + way], self.width
        steps, n = seq.shape
        out = np.empty((steps, k, n), np.float32)
        kept = np.empty((steps, 4 * k, n), np.float32) if keep else None
        state, x, gates, scratch = (np.zeros((k, n), np.float32), *(np.empty((3 * k, n), np.float32) for _ in range(3)))
        for t in range(steps):
            np.take(table, seq[t], axis=1, out=x, mode="clip")
            np.matmul(turn, state, out=gates)
            open_ = x[:2 * k]
            open_ += gates[:2 * k]
            _soft(open_, scratch[:2 * k])
            open_ *= 0.5
            open_ += 0.5
            hold, reset, new = open_[:k], open_[k:], x[2 * k:]
            if keep:
                kept[t, k:3 * k], kept[t, 3 * k:] = open_, gates[2 * k:]
            gates[2 * k:] *= reset
            new += gates[2 * k:]
            _soft(new, scratch[2 * k:])
            if keep:
                kept[t, :k] = new
            here = out[t]
            np.subtract(state, new, out=here)
            here *= hold
            here += new
            state = here
        return out, kept

    def back(self, way: int, seq: np.ndarray, out: np.ndarray, kept: np.ndarray, error: np.ndarray):
        """Gradients of the input table and the recurrent weights from the errors of all states."""
        k, turn = self.width, self.weights[2 + way]
        steps, n = seq.shape
        d_turn, at_input = np.zeros_like(turn), np.empty((3 * k, steps, n), np.float32)
        d = np.zeros((k, n), np.float32)
        for t in range(steps - 1, -1, -1):
            d = d + error[t]
            before = out[t - 1] if t else np.zeros((k, n), np.float32)
            new, hold, reset, inner = kept[t, :k], kept[t, k:2 * k], kept[t, 2 * k:3 * k], kept[t, 3 * k:]
            d_new = d * (1 - hold) * (1 - np.abs(new)) ** 2
            slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            d_gates = np.concatenate([d * (before - new) * slope(hold), d_new * inner * slope(reset), d_new * reset])
            at_input[:2 * k, t], at_input[2 * k:, t] = d_gates[:2 * k], d_new
            d_turn += d_gates @ before.T
            d = d * hold + turn.T @ d_gates
        flat = seq.ravel()
        d_table = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in at_input]).astype(np.float32)
        return d_table, d_turn

    def logits(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        return np.matmul(self.weights[4], ahead) + np.matmul(self.weights[5], behind) + self.weights[6]

    def probabilities(self, seq: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities of every language at every position: [steps, languages, windows]; places behind a window's end mean nothing."""
        turned = _turn(len(seq), length)
        ahead, _ = self.states(0, seq)
        behind, _ = self.states(1, np.take_along_axis(seq, turned, 0))
        z = np.matmul(self.weights[4], ahead)
        z += self.weights[6]
        z += _turned_back(np.matmul(self.weights[5], behind), turned, length)
        return _softmax(z)

    def gradients(self, seq: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list]:
        """Mean cross-entropy of all positions and its gradients."""
        steps, n = seq.shape
        turned = _turn(steps, length)
        back_seq = np.take_along_axis(seq, turned, 0)
        ahead, kept = self.states(0, seq, True)
        behind, kept_back = self.states(1, back_seq, True)
        aligned = np.take_along_axis(behind, turned[:, None, :], 0)
        p = _softmax(self.logits(ahead, aligned))
        inside = np.arange(steps)[:, None] < length
        total = np.float32(max(int(length.sum()), 1))
        own = p[:, label, np.arange(n)]
        loss = float(-(np.log(np.maximum(own, 1e-30)) * inside).sum() / total)
        p[:, label, np.arange(n)] -= 1
        p *= (inside / total)[:, None, :].astype(np.float32)
        summed = lambda h: np.matmul(p, h.transpose(0, 2, 1)).sum(0)
        error_back = np.take_along_axis(np.matmul(self.weights[5].T, p), turned[:, None, :], 0) * (np.arange(steps)[:, None] < length)[:, None, :]
        table, turn = self.back(0, seq, ahead, kept, np.matmul(self.weights[4].T, p))
        table_back, turn_back = self.back(1, back_seq, behind, kept_back, error_back)
        return loss, [table, table_back, turn, turn_back, summed(ahead), summed(aligned), p.sum((0, 2))[:, None]]


def _soft(x: np.ndarray, scratch: np.ndarray) -> None:
    """x / (1 + |x|) in place: it saturates like tanh at a fifth of its time."""
    np.abs(x, out=scratch)
    scratch += 1
    x /= scratch


def _turn(steps: int, length: np.ndarray) -> np.ndarray:
    """For each place the place from the other end of its window; places behind the end stay."""
    t = np.arange(steps)[:, None]
    return np.where(t < length, length - 1 - t, t)


def _turned_back(x: np.ndarray, turned: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the backward direction says, by place."""
    if len(length) and length.min() == len(x):
        return x[::-1]
    return np.take_along_axis(x, turned[:, None, :], 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _matrix(windows: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in windows], np.int64)
    seq = np.zeros((len(windows), steps), np.uint8)
    for i, w in enumerate(windows):
        seq[i, :len(w)] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(seq.T), length


def fit(windows: list[bytes], labels: list[str], epochs: int = EPOCHS, width: int = WIDTH, rate: float = RATE, seed: int = SEED, window: int = WINDOW) -> Network | None:
    """A network trained on labelled windows; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    model = Network(languages, width, seed)
    seq, length = _matrix(windows, window)
    seq = seq.astype(np.intp)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    per_epoch = -(-len(y) // BATCH)
    first, second, done = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for _ in range(epochs if len(languages) > 1 else 0):
        for rows in np.array_split(rng.permutation(len(y)), per_epoch):
            _, gradients = model.gradients(seq[:, rows], length[rows], y[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            now = rate * (1 - done / (epochs * per_epoch))
            done += 1
            for w, g, m, v in zip(model.weights, gradients, first, second):
                g = g * min(1.0, 1.0 / max(size, 1e-12))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.99 ** done)) + 1e-8)
    return model


def _windows(body: np.ndarray, offsets: np.ndarray, window: int):
    """Start, length and document of the windows of a slice, shortest last ones included."""
    size = np.diff(offsets)
    number = -(-size // window)
    doc = np.repeat(np.arange(len(size)), number)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = offsets[doc] + nth * window
    return start, np.minimum(window, offsets[doc + 1] - start), doc


def pooled(model: Network, body: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean probabilities of every document of a slice, [documents, languages]; zeros for empty ones."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    for doc, p, length in _labelled(model, body, offsets, window):
        inside = p.sum(0) if length.min() == len(p) else (p * (np.arange(len(p))[:, None] < length)[:, None, :]).sum(0)
        for k in range(len(total.T)):
            total[:, k] += np.bincount(doc, weights=inside[k], minlength=len(total))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _labelled(model: Network, body: np.ndarray, offsets: np.ndarray, window: int):
    """Windows of like length together: document, probabilities of the positions, length."""
    start, length, doc = _windows(body, offsets, window)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), TOGETHER):
        at = order[i:i + TOGETHER]
        steps = int(length[at[0]])
        place = np.minimum(start[at] + np.arange(steps)[:, None], len(body) - 1)
        yield doc[at], model.probabilities(body[place].astype(np.intp), length[at]), length[at]


def spans(model: Network, text: str | None, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """Runs of positions with the same label: start and end byte and language."""
    body = np.frombuffer((text or "").encode(), np.uint8)
    labels = np.zeros(len(body), np.int64)
    start, length, _ = _windows(body, np.array([0, len(body)]), window)
    for s, n in zip(start, length):
        labels[s:s + n] = model.probabilities(body[s:s + n, None].astype(np.intp), np.array([n]))[:, :, 0].argmax(1)
    edges = np.flatnonzero(np.diff(labels, prepend=-1, append=-1))
    return [(int(a), int(b), model.languages[labels[a]]) for a, b in zip(edges[:-1], edges[1:])]


def _predict(model, window):
    def predict(tables):
        for batch in tables:
            body, offsets = batches.utf8(batch.column("text"))
            best, share = [], []
            for row, end, part, edges in batches.slices(body, offsets, SLICE):
                p = pooled(model, part, edges, window)
                best.append(p.argmax(1))
                share.append(p.max(1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            share = np.concatenate(share) if share else np.zeros(0)
            letters = np.asarray(batch.column("letters").fill_null(False), bool)
            lang = pa.DictionaryArray.from_arrays(pa.array(np.where(letters, best, len(model.languages))), pa.array([*model.languages, "und"], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), lang.cast(pa.string()), pa.array(np.where(letters, np.minimum(share, 1.0), 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def held_out(doc_id, fold: int = 3, at: int = 1):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % fold == at


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, window: int = WINDOW, **options) -> Network | None:
    """Fit on windows of documents with a ``lang`` that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    raw = F.col("text").cast("binary")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.greatest(F.octet_length(raw) - (window - 1), F.lit(1))).cast("int") + 1
    frequent = known.groupBy("lang").agg(F.count("lang").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    order = W.partitionBy("lang").orderBy("order", "window")
    chosen = (known.select("lang", F.md5(F.col("doc_id").cast("string")).alias("order"), F.substring(raw, place, F.lit(window)).alias("window"))
                   .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample).join(F.broadcast(frequent), "lang"))
    rows = chosen.select("lang", "window").orderBy("lang", "nth").collect()  # at most sample * languages windows
    return fit([bytes(r["window"]) for r in rows], [r["lang"] for r in rows], window=window, **options)


def identify(docs: DataFrame, model: Network | None, window: int = WINDOW) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.col("text").rlike(r"\p{L}").alias("letters"))
    if model is None:
        return marked.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_predict(model, window), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    return identify(docs, train(docs, sample, **options))
