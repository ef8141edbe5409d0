"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words, each followed by one blank, and an end
byte.  Every byte is eight binary decisions; a decision in the context of the
last ``d`` bytes, for each d from 0 to ``DEPTH``, has a Krichevsky-Trofimov
estimate, and the estimates of all depths are mixed by the context-tree weights
of the training counts.  A depth whose context never occurs in training takes
no part in the mixture.  Code lengths are those of the trained, fixed tree.

Work on Spark: documents are hashed into blocks of bounded size.  A block sends
each distinct string of DEPTH + 1 bytes and each distinct word once, with its
training count.  Counts meet by string; the trees below a context of two bytes
are weighted in one group (at most 256 ** (DEPTH - 1) strings, whatever the corpus);
the two upper levels have at most 256 * 255 nodes and are the only thing that
passes the driver.  Answers go back to the blocks that asked, by a join.

Defined results: null texts are empty (only the end is scored); a null doc_id
has remainder 0, so it is held out; repeated rows are scored one by one; no rows
give no rows; a corpus without training rows gives one bit a decision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dailybars.llm import batches
from dailybars.plans.cut import bucketed, written

DEPTH = 5
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
GROUP_STRINGS = 250_000
END = 0x0A
WORD = np.uint64(1 << 63)


def _stream(body, offsets):
    """Bytes to score of a slice of documents, and where each document starts."""
    low = batches.LOWER[body]
    start, end = batches.runs(~batches.BLANK[low], offsets)
    doc = batches.row_numbers(offsets, start)
    length = end - start
    per_doc = np.bincount(doc, minlength=len(offsets) - 1)
    size = np.bincount(doc, weights=length, minlength=len(offsets) - 1).astype(np.int64) + per_doc + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.full(begin[-1], 0x20, np.uint8)
    out[begin[1:] - 1] = END
    word_at = np.concatenate(([0], np.cumsum(length + 1)))[:-1] + doc
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(word_at, length) + inner] = low[np.repeat(start, length) + inner]
    return out, begin, low, start, end, doc


def _strings(out, begin, depth):
    """Strings of ``depth`` context bytes and the byte itself, as numbers; zeros before a document."""
    key = out.astype(np.uint64)
    place = np.arange(len(out)) - np.repeat(begin[:-1], np.diff(begin))
    for d in range(1, depth + 1):
        back = np.zeros(len(out), np.uint64)
        back[d:] = out[:-d]
        back[place < d] = 0
        key |= back << np.uint64(8 * d)
    return key


def _keys(text, depth, powers):
    """Per slice: first row, rows, (key, row) of all strings and all words, the end included."""
    body, offsets = batches.utf8(text)
    for row, until, part, edges in batches.slices(body, offsets, SLICE_BYTES, 1 << 16):
        out, begin, low, start, end, doc = _stream(part, edges)
        strings = _strings(out, begin, depth)
        of = np.repeat(np.arange(until - row), np.diff(begin))
        named = powers.spans(powers.prefix(low), start, end) | WORD
        final = np.full(until - row, WORD | np.uint64(END), np.uint64)
        yield row, until - row, (strings, of), (np.concatenate((named, final)), np.concatenate((doc, np.arange(until - row))))


def _sum_by(keys, weights):
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _ask(depth):
    """What a block needs to know: each of its keys once, with its count in training rows."""
    powers = batches.Powers()

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = batches.unpack(table)
        train = ~table["held_out"].to_numpy()
        found = []
        for row, n, strings, named in _keys(table["text"], depth, powers):
            learn = train[row:row + n]
            for keys, of in (strings, named):
                found.append(_sum_by(keys, learn[of]))
            if len(found) >= 16:
                found = [_sum_by(*(np.concatenate(x) for x in zip(*found)))]
        keys, counts = _sum_by(*(np.concatenate(x) for x in zip(*found)))
        return pa.table({"block": np.full(len(keys), block, np.int32), "key": keys.view(np.int64), "n": counts})

    return ask


def _log_gamma(x):
    """ln Gamma for x >= 0.5 by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)


def kt(n0, n1):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _weigh(own, below):
    return np.logaddexp(own, below) - math.log(2)


class _Level:
    """Nodes of one depth for one of the eight decisions."""

    def __init__(self, node, ones, counts, child=None):
        ids, self.first, self.of = np.unique(node, return_index=True, return_inverse=True)
        self.ids = ids
        self.n1 = np.bincount(self.of, weights=counts * ones, minlength=len(ids))
        self.n0 = np.bincount(self.of, weights=counts * (1 - ones), minlength=len(ids))
        self.own = kt(self.n0, self.n1)
        if child is None:
            self.below, self.all = None, self.own
        else:
            self.below = np.bincount(self.of[child.first], weights=child.all, minlength=len(ids))
            self.all = _weigh(self.own, self.below)

    def step(self, ones, deeper, child):
        """Probability of the decisions taken, mixed with that of the deeper contexts."""
        n0, n1 = self.n0[self.of], self.n1[self.of]
        here = (np.where(ones == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
        if child is None:
            return here
        share = _share(self.own - self.below)[self.of]
        seen = (child.n0 + child.n1)[child.of] > 0
        return np.where(seen, share * here + (1 - share) * deeper, here)


def _share(log_odds):
    return 1 / (1 + np.exp(np.clip(-log_odds, -700, 700)))


def _levels(keys, counts, depth, bit):
    """Levels from ``depth`` up to 2 for one decision, deepest first."""
    byte = keys & np.uint64(255)
    ones = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
    prefix = (np.uint64(1 << bit)) | (byte >> np.uint64(8 - bit)) if bit else np.full(len(keys), 1, np.uint64)
    levels = []
    for d in range(depth, 1, -1):
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
        levels.append(_Level(context << np.uint64(8) | prefix, ones, counts, levels[-1] if levels else None))
    return ones, prefix.astype(np.int64), levels


def _subtree(depth):
    """Totals of the nodes under one context of two bytes, for the levels above."""

    def subtree(table: pa.Table) -> pa.Table:
        keys, counts = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(float)
        rows = []
        for bit in range(8):
            _, _, levels = _levels(keys, counts, depth, bit)
            top = levels[-1]
            rows.append((top.ids, top.n0, top.n1, top.all))
        ids, n0, n1, weighted = (np.concatenate(x) for x in zip(*rows))
        return pa.table({"last": ((ids >> np.uint64(8)) & np.uint64(255)).astype(np.int32), "node": (ids & np.uint64(255)).astype(np.int32), "n0": n0, "n1": n1, "weighted": weighted})

    return subtree


def _upper(rows):
    """Mixing shares, estimates and counts of depths 1 and 0 as (256, 256) and (256,) arrays."""
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        n0[r["last"], r["node"]], n1[r["last"], r["node"]], below[r["last"], r["node"]] = r["n0"], r["n1"], r["weighted"]
    own = kt(n0, n1)
    root0, root1 = n0.sum(0), n1.sum(0)
    whole = _weigh(own, below)
    whole[n0 + n1 == 0] = 0
    return {"n0": n0, "n1": n1, "share": _share(own - below), "r0": root0, "r1": root1, "root": _share(kt(root0, root1) - whole.sum(0))}


def _answer(depth, upper):
    """log10 probability of each string's byte in its context."""

    def answer(table: pa.Table) -> pa.Table:
        keys, counts = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(float)
        last = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        score = np.zeros(len(keys))
        for bit in range(8):
            ones, prefix, levels = _levels(keys, counts, depth, bit)
            p, child = None, None
            for level in levels:
                p, child = level.step(ones, p, child), level
            seen = (child.n0 + child.n1)[child.of] > 0
            for n0, n1, share in ((upper["n0"][last, prefix], upper["n1"][last, prefix], upper["share"][last, prefix]), (upper["r0"][prefix], upper["r1"][prefix], upper["root"][prefix])):
                here = (np.where(ones == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
                p = np.where(seen, share * here + (1 - share) * p, here)
                seen = n0 + n1 > 0
            score += np.log10(p)
        return pa.table({"key": keys.view(np.int64), "value": score})

    return answer


def _apply(depth, tokens):
    """Scores of a block's documents from the answers to its keys: log10 probabilities of strings, counts of words."""
    powers = batches.Powers()

    def apply(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = batches.unpack(docs)
        keys = known["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, value = keys[order], known["value"].to_numpy()[order]
        out = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
        for row, n, (strings, of), (named, named_of) in _keys(docs["text"], depth, powers):
            room = np.uint64(64 - 8 * (depth + 1))
            hit = np.sort(strings << room | of.astype(np.uint64))
            first = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
            times, hit = np.diff(np.append(first, len(hit))), hit[first]
            at = np.searchsorted(keys, hit >> room)
            out["score"].append(np.bincount((hit & np.uint64((1 << int(room)) - 1)).astype(np.int64), weights=value[at] * times, minlength=n))
            at = np.searchsorted(keys, named)
            out["n_tokens"].append(np.bincount(named_of, minlength=n))
            out["n_known"].append(np.bincount(named_of, weights=value[at] > 0, minlength=n))
            out["base_score"].append(np.bincount(named_of, weights=np.log10((value[at] + 0.1) / tokens), minlength=n))
        whole = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": whole["n_tokens"].astype(np.int64), "n_known": whole["n_known"].astype(np.int64), "base_score": whole["base_score"], "score": whole["score"]})

    return apply


def score(docs: DataFrame, depth: int = DEPTH, fold: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Context-tree and word-frequency scores of every document.

    Learns from rows whose crc32(doc_id) modulo ``fold`` is not 0.  ``depth`` is 2 to 5
    (a string of six bytes and a row number share one 64-bit word).
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // block_bytes))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % fold == 0
    dealt = (docs.select("doc_id", "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
             .mapInArrow(batches.pack, "block int, packed binary"))
    asked = bucketed(dealt.groupBy("block").applyInArrow(_ask(depth), "block int, key long, n long"), "key", "ctw_asked")
    totals = asked.groupBy("key").agg(F.sum("n").alias("n"))
    strings = written(totals.filter("key >= 0"), "ctw-strings")
    groups = max(1, strings.count() // GROUP_STRINGS)
    strings = strings.withColumn("under", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(groups)))
    named = totals.filter("key < 0")
    upper = _upper(strings.groupBy("under").applyInArrow(_subtree(depth), "last int, node int, n0 double, n1 double, weighted double")
                   .groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).collect())  # at most 256 * 255 rows
    word = named.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n, v = word["n"] or 0, word["v"]
    model = strings.groupBy("under").applyInArrow(_answer(depth, upper), "key long, value double").unionByName(named.select("key", F.col("n").cast("double").alias("value")))
    known = asked.select("block", "key").join(model, "key").select("block", "key", "value")
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _apply(depth, n + 0.1 * (v + 1)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
