"""Collocations from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and
pieces into words.  Nodes of the graph are three words in a row, edges are four:
an edge joins the two nodes that overlap in its middle words, and its weight is
how often the four words occur.  At every word of a piece exactly one longest gram
starts: an edge, or, at the last three words, what is left of the piece.  These
are all that is counted.  The count of a node is the flow out of it plus the
pieces that end there, a pair's count is the flow of the nodes it starts plus its
own piece ends, and so on to single words, so no shorter gram is gathered from
the texts.

Two things keep the graph small, and both leave counts of ``least`` or more exact.
First, grams of one to four words are counted in ``2 ** CELL_BITS`` cells by hash; what
shares its cell with fewer than ``least`` occurrences is not a phrase and in none, so
the gram that starts at a word ends before it, as at the end of a piece.  The cells
become a bitmap of fixed size (16 MB), the only thing sent to every task; where a
corpus fills all cells, fewer grams are cut and more are shuffled.  Second, edges of ``least`` or more are compacted: while a node has
one edge in, one edge out and no other flow, its edges are one path, found by
pointer doubling.  A passage copied a thousand times is one row, and what
stands inside a path is known to lie within a longer phrase of the same count.

A phrase of two to four words scores floor(2000000 a / (l + r)) at its weakest cut.

Defined results: null texts have no words; a null lang is ``und``; repeated rows
count one by one; blanks of any number part words; words may be of any length; no
rows give no phrases; other columns are not used.  Ties go by count, then by the
phrase's bytes.  Decimals of 38 digits hold all products.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.llm import batches
from dailybars.plans.cut import written

LEAST = 30
TOP = 2000
SHARE = (80, 100)
CELL_BITS = 27
RANGE_BITS = 18
SLICE = 3 << 20

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


class Words:
    """Lower-cased words of a slice, written one after another with one blank behind each."""

    def __init__(self, body, offsets, langs, powers):
        low = batches.LOWER[body]
        start, end = batches.runs(~GAP[low], offsets)
        doc = batches.row_numbers(offsets, start)
        self.n, self.length = len(start), end - start
        self.hash = powers.spans(powers.prefix(low), start, end)
        breaks = np.cumsum(BREAK[low])
        piece = breaks[start] if self.n else np.zeros(0, np.int64)
        #: the next word follows in the same piece
        self.on = np.append((doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), False) if self.n else np.zeros(0, bool)
        self.lang = langs[doc]
        self.at = np.cumsum(self.length + 1) - self.length - 1
        self.stream = np.full(int((self.length + 1).sum()), 0x20, np.uint8)
        inner = np.arange(int(self.length.sum())) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.stream[np.repeat(self.at, self.length) + inner] = low[np.repeat(start, self.length) + inner]

    def cells(self, seeds, bits):
        """For one to four words which grams lie in a piece, and the cells of all that start at each word."""
        key, inside = batches.mix(self.hash ^ seeds[self.lang], 1), np.ones(self.n, bool)
        for k in range(1, 5):
            yield inside, (key >> np.uint64(64 - bits)).astype(np.uint32)
            following = np.append(self.hash[k:], np.zeros(min(k, self.n), np.uint64))
            key = batches.mix(key * np.uint64(3) ^ following, k + 1)
            inside = inside & np.append(self.on[k - 1:], np.zeros(min(k - 1, self.n), bool))

    def texts(self, first, last):
        """The stretches from word ``first`` to word ``last`` as an Arrow column."""
        start, size = self.at[first], self.at[last] + self.length[last] - self.at[first]
        edges = np.zeros(len(first) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        inside = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(self.stream[np.repeat(start, size) + inside]))

    def numbers(self):
        """Equal numbers for equal words, exactly."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        model = first[number]
        same = self.length[model] == self.length
        if same.all():
            step = np.arange(len(self.stream)) - np.repeat(self.at, self.length + 1)
            if np.array_equal(self.stream[np.repeat(self.at[model], self.length + 1) + step], self.stream):
                return number
        seen = {}  # two words of one hash
        raw = self.stream.tobytes()
        return np.array([seen.setdefault(raw[a:a + n], len(seen)) for a, n in zip(self.at.tolist(), self.length.tolist())])


def _slices(tables, powers):
    """Words of each slice, the languages of its batch and a seed for each."""
    for batch in tables:
        body, offsets = batches.utf8(batch.column(0))
        langs = batch.column(1).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seeds = np.array([zlib.crc32(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64) << np.uint64(20)
        for row, end, part, edges in batches.slices(body, offsets, SLICE):
            yield Words(part, edges, codes[row:end], powers), langs.dictionary, seeds


def _count_cells(least, bits):
    """How often words and pairs meet each cell, up to ``least``, as compressed ranges; and words by language."""
    def count(tables):
        powers, cells, words, codec = batches.Powers(), None, {}, pa.Codec("zstd")
        for part, langs, seeds in _slices(tables, powers):
            if not part.n:
                continue
            cells = np.zeros(1 << bits, np.uint8) if cells is None else cells
            at, times = np.unique(np.concatenate([cell[inside] for inside, cell in part.cells(seeds, bits)]), return_counts=True)
            cells[at] = np.minimum(cells[at] + times, least)
            for lang, n in zip(langs.to_pylist(), np.bincount(part.lang, minlength=len(langs)).tolist()):
                words[lang] = words.get(lang, 0) + n
        if cells is None:
            return
        step = 1 << min(RANGE_BITS, bits)
        for k in range(len(cells) // step):
            yield _rows([k], [codec.compress(cells[k * step:(k + 1) * step].tobytes()).to_pybytes()], [None], [None])
        yield _rows([None] * len(words), [None] * len(words), list(words), list(words.values()))

    return count


def _rows(ranges, packed, langs, n):
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(packed, pa.binary()), pa.array(langs, pa.string()), pa.array(n, pa.int64())],
                                      names=["range", "packed", "lang", "n"])


def _bitmaps(least, step):
    """Ranges in order, added up one after another: which cells hold ``least`` or more."""
    def add(tables):
        held, total, codec = None, None, pa.Codec("zstd")

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["range", "bits"])

        for batch in tables:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != held:
                    if held is not None:
                        yield out()
                    held, total = k, np.zeros(step, np.int16)
                total = np.minimum(total + np.frombuffer(codec.decompress(packed.as_buffer(), step), np.uint8), least).astype(np.int16)
        if held is not None:
            yield out()

    return add


GRAMS = "lang string, k int, phrase string, n bigint"


def _longest_grams(bitmap, bits):
    """The longest gram that starts at each word, counted for every slice."""
    def find(tables):
        powers, held = batches.Powers(), np.frombuffer(bitmap.value, np.uint8)
        often = lambda cell: (held[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
        for part, langs, seeds in _slices(tables, powers):
            if not part.n:
                continue
            size, on = np.zeros(part.n, np.int64), np.ones(part.n, bool)
            for inside, cell in part.cells(seeds, bits):
                on = on & inside & often(cell)
                size += on
            number = part.numbers()
            several = int(number.max()) + 1
            named = part.lang * several + number
            pair = np.zeros(part.n + 2, np.int64)
            needed = size > 1
            needed[np.flatnonzero(size == 4) + 2] = True
            at = np.flatnonzero(needed)
            kinds, pair[at] = np.unique(named[at] * several + number[np.minimum(at + 1, part.n - 1)], return_inverse=True)
            third = np.append(number, [0, 0])
            for k in (1, 2, 3, 4):
                at = np.flatnonzero(size == k)
                key = (named[at], pair[at], pair[at] * several + third[at + 2], pair[at] * len(kinds) + pair[at + 2])[k - 1]
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                first = at[first]
                if len(first):
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(part.lang[first])).cast(pa.string()), pa.array(np.full(len(first), k), pa.int32()),
                         part.texts(first, first + k - 1).cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "k", "phrase", "n"])

    return find


def _joined(phrase, n: int):
    """The first n words of a phrase, or the last -n ones."""
    return F.substring_index(phrase, " ", n)


def graph(docs: DataFrame, least: int = LEAST, cell_bits: int = CELL_BITS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, k, phrase, f) of all phrases of one to four words that occur ``least`` times or more, and words by lang."""
    if not 0 < least < 256:
        raise ValueError("least must lie between 1 and 255")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = written(texts.mapInArrow(_count_cells(least, cell_bits), "range int, packed binary, lang string, n bigint"), "cells")
    words = counted.filter("range is null").groupBy("lang").agg(F.sum("n").alias("n"))
    step = 1 << min(RANGE_BITS, cell_bits)
    ordered = counted.filter("range is not null").select("range", "packed").repartition("range").sortWithinPartitions("range")
    bits = {r["range"]: r["bits"] for r in ordered.mapInArrow(_bitmaps(least, step), "range int, bits binary").collect()}  # 2 ** (cell_bits - 3) bytes in all
    bitmap = spark.sparkContext.broadcast(b"".join(bits.get(k, bytes(step // 8)) for k in range((1 << cell_bits) // step)))
    grams = written(texts.mapInArrow(_longest_grams(bitmap, cell_bits), GRAMS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")), "grams")
    bitmap.unpersist()
    levels = [grams.filter("k = 4").select("lang", "phrase", "f")]
    for k in (3, 2, 1):  # flow out of a node and the pieces that end in it
        flow = levels[-1].select("lang", _joined("phrase", k).alias("phrase"), "f").unionByName(grams.filter(F.col("k") == k).select("lang", "phrase", "f"))
        levels.append(flow.groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    kept = [level.filter(F.col("f") >= least).select("lang", F.lit(4 - i).alias("k"), "phrase", "f") for i, level in enumerate(levels)]
    return written(reduce(DataFrame.unionByName, kept), "phrases"), words


def paths(counts: DataFrame) -> DataFrame:
    """Edges compacted along unary nodes: (lang, path, f), each path a passage of four or more words that occurs f times."""
    edges = counts.filter("k = 4").select("lang", F.col("phrase").alias("edge"), "f")
    into = edges.groupBy("lang", _joined("edge", -3).alias("node")).agg(F.count("f").alias("n_in"), F.min("edge").alias("before"), F.min("f").alias("f_in"))
    out = edges.groupBy("lang", _joined("edge", 3).alias("node")).agg(F.count("f").alias("n_out"), F.min("edge").alias("after"), F.min("f").alias("f_out"))
    flow = counts.filter("k = 3").select("lang", F.col("phrase").alias("node"), "f")
    unary = (into.join(out, ["lang", "node"]).join(flow, ["lang", "node"])
                 .filter("n_in = 1 and n_out = 1 and f_in = f and f_out = f").select("lang", F.col("before").alias("edge"), F.col("after").alias("to")))
    steps = written(edges.join(unary, ["lang", "edge"], "left").select(
        "lang", "edge", "f", F.coalesce("to", "edge").alias("to"), F.col("to").isNotNull().cast("bigint").alias("steps")), "steps")
    while steps.filter("steps > 0").limit(1).count():
        further = steps.filter("steps > 0").select("lang", F.col("edge").alias("to"), F.col("to").alias("on"), F.col("steps").alias("more"))
        steps = written(steps.join(further, ["lang", "to"], "left").select(
            "lang", "edge", "f", F.coalesce("on", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("on").isNotNull().alias("moved")), "steps")
        if not steps.filter("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "edge"))), lambda x: x["edge"])
    return (steps.groupBy("lang", "to").agg(F.first("f").alias("f"), in_order.alias("edges"))
                 .select("lang", F.concat_ws(" ", F.col("edges")[0], F.transform(F.expr("slice(edges, 2, size(edges))"), lambda e: _joined(e, -1))).alias("path"), "f"))


def _inside(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases of two and three words that lie within longer ones, with the largest count of these."""
    words = F.split("path", " ", -1)
    within = lambda n: F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).alias("phrase")
    threes = counts.filter("k = 3")
    parts = [paths.select("lang", within(n), "f") for n in (2, 3)]
    parts += [threes.select("lang", _joined("phrase", n).alias("phrase"), "f") for n in (2, -2)]
    return reduce(DataFrame.unionByName, parts).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: tuple[int, int] = SHARE, cell_bits: int = CELL_BITS) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    counts, words = graph(docs, least, cell_bits)
    candidates = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    exact = lambda c, times: F.col(c).cast("decimal(28,0)") * F.lit(times).cast("decimal(9,0)")
    kept = (candidates.join(_inside(paths(counts), counts), ["lang", "phrase"], "left")
                      .filter(F.col("longer").isNull() | (exact("longer", share[1]) < exact("a", share[0]))).drop("longer"))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({
        "first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    known = lambda phrase, f: counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    scored = (cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
                  .withColumn("score", F.expr("(cast(a as decimal(28,0)) * 2000000BD) div (cast(l as decimal(28,0)) + r)"))
                  .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")))
    order = W.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "w.l", "w.r", "n", "w.score")


SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (
  select lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(i + 4, len(w) + 1)), lambda j: w[i:j])))) as s
  from p where len(w) > 0),
f as (select lang, len(s) as k, array_to_string(s, ' ') as phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by all),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
parts as (
  select lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) as phrase
  from c where k > 2),
longer as (select lang, phrase, max(a) as most from parts group by all),
kept as (
  select c.* from c left join longer on c.lang = longer.lang and c.phrase = longer.phrase
  where longer.most is null or 100 * longer.most::hugeint < 80 * c.a::hugeint),
cuts as (
  select kept.*, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:k], ' ') as tail
  from kept, (values (1), (2), (3)) as x(j) where j < k),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, j, x.f as l, y.f as r, ((2000000::hugeint * cuts.a) // (x.f + y.f))::bigint as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = head join f y on y.lang = cuts.lang and y.phrase = tail),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select w.lang, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank, w.phrase, a, l, r, n.n, score
from weakest w join n on n.lang = w.lang qualify rank <= 2000
"""
