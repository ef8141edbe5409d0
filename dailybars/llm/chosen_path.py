"""Jaccard self-join of word n-grams by chosen paths.

A document is the set of hashes of its n-grams of ``K`` lower-cased words (texts of
fewer words: one n-gram of all).  In each of several runs a set picks every member
whose hash is below 1 / (SIMILARITY * size); sets with a common pick meet in a
bucket.  Two sets of the wanted similarity share at least one pick a run on
average, so one run finds a pair with probability 1 - 1/e or more, and the number
of runs follows from the target ``RECALL``.  A bucket of more than ``SMALL`` sets is
split again by picks of its own (``AGAIN`` repeats), which separates sets that only
share a passage; not so if most of its sets have the same smallest pick, as sets
that are alike do.  What stays large is compared exactly, in pairs of blocks of
about ``BLOCK`` sets, so no task holds it whole.

Equal sets are one from the start, with their number of copies.  Buckets of one set
are dropped.  A pair is looked at only in the smallest-numbered bucket that both
share, and a set is sent (from its text, with all members) only to buckets where
it has such a pair.  Texts are shuffled only if a bitmap of hashes says that their
set may be wanted; a hash that meets another's lets one more text through, and the
join with the wanted ids decides.  Tasks compare sets exactly and return, for each set, the
number of linked documents and the smallest linked set; no pair leaves a task.
Classes are connected components over these (large-star and small-star rounds).

Defined results: null and blank texts have no n-grams and are classes of their
own, without links; repeated rows and equal texts are linked; class_id is the
smallest doc_id of the class (null ids aside); no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dailybars.llm import batches
from dailybars.plans.cut import written

K = 5
SIMILARITY = 0.8
RECALL = 0.9999
SMALL = 400
BLOCK = 400
AGAIN = 3
CHUNK_ROWS = 2000
PAIRS = 20_000
SLICE = 1 << 19
CELLS = 1 << 26
TOP = float(1 << 64)


def sets_of(body, offsets, powers, k):
    """Distinct n-grams of the documents of a slice: sorted hashes and document, by document."""
    _, _, doc, named = batches.words(body, offsets, powers)
    gram, of, _ = batches.grams(named, doc, k, short=True)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    return gram[new], of[new]


def _lists(values, of, rows):
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))), pa.int32()), pa.array(values.view(np.int64)))


def picks(gram, limit, seeds):
    """(position, bucket) of the members picked under each seed; ``limit``: the pick bound of each member's set."""
    at, buckets = [], []
    for seed in seeds:
        scattered = batches.mix(gram, seed)
        hit = np.flatnonzero(scattered <= limit)
        at.append(hit)
        buckets.append(batches.mix(scattered[hit], seed + 1))
    return np.concatenate(at), np.concatenate(buckets)


def _limit(size, similarity):
    share = np.minimum(1.0, 1.0 / (similarity * np.maximum(size, 1)))
    return np.where(share >= 1, np.uint64(batches._MASK), (np.minimum(share, 1 - 1e-12) * TOP).astype(np.uint64))


def _describe(k, similarity, runs):
    """Identity, size and root picks of each document's set."""
    powers = batches.Powers()

    def describe(tables):
        for batch in batches.releasing(tables):
            body, offsets = batches.utf8(batch.column("text"))
            for row, end, part, edges in batches.slices(body, offsets, SLICE):
                rows = end - row
                gram, of = sets_of(part, edges, powers, k)
                size = np.bincount(of, minlength=rows)
                first = np.cumsum(size) - size
                full = np.flatnonzero(size)
                ids = np.zeros((rows, 2), np.uint64)
                for j in range(2):
                    if len(full):
                        ids[full, j] = np.add.reduceat(batches.mix(gram, 91 + j), first[full])
                flat = ids.astype(">u8").tobytes()
                named = pa.array([flat[16 * i:16 * i + 16] if size[i] else None for i in range(rows)], pa.binary())
                at, buckets = picks(gram, _limit(size, similarity)[of], range(1, 2 * runs, 2))
                owner = of[at]
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows), batch.column("text_id").slice(row, rows), named, pa.array(size), _lists(buckets[order], owner, rows)],
                                                 names=["doc_id", "text_id", "sid", "size", "picks"])

    return describe


def _members(k):
    """The set of each text in place of it, the first column; the others stay."""
    powers = batches.Powers()

    def members(tables):
        for batch in batches.releasing(tables):
            body, offsets = batches.utf8(batch.column("text"))
            for row, end, part, edges in batches.slices(body, offsets, SLICE):
                gram, of = sets_of(part, edges, powers, k)
                yield batch.slice(row, end - row).set_column(0, "grams", _lists(gram, of, end - row))

    return members


def _split(similarity, again):
    """Picks inside a bucket: seeds come from the bucket, so all its sets pick alike."""

    def split(tables):
        for batch in batches.releasing(tables):
            sid, bucket = batch.column("sid"), batch.column("bucket").to_numpy().view(np.uint64)
            lists = batch.column("grams")
            edge = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            gram = lists.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(bucket)), np.diff(edge))
            limit = _limit(np.diff(edge), similarity)[of]
            at, child = picks(gram ^ batches.mix(bucket, 5)[of], limit, range(1001, 1001 + 2 * again, 2))
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(of[at])), pa.array(batches.mix(child ^ bucket[of[at]], 7).view(np.int64))], names=["sid", "bucket"])

    return split


def _ranks(lists):
    """Values of list rows as ranks, with row edges; equal values have equal ranks."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    edge = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    values, rank = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    return values, rank, edge


def _pairs(rows, crossing, own, size, similarity):
    """Pairs of rows of one unit whose sizes allow the similarity."""
    i, j = np.triu_indices(len(rows), 1)
    i, j = rows[i], rows[j]
    keep = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    if crossing:
        keep &= own[i] != own[j]
    return i[keep], j[keep]


def _first_common(i, j, here, rank, edge, known, width):
    """Whether ``here`` is the smallest leaf that both rows of a pair have; ``known``: sorted row * width + leaf."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), PAIRS):
        p, q = i[a:a + PAIRS], j[a:a + PAIRS]
        many = edge[p + 1] - edge[p]
        first = np.cumsum(many) - many
        at = np.repeat(edge[p] - first, many) + np.arange(int(many.sum()))
        ask = np.repeat(q, many) * width + rank[at]
        slot = np.minimum(np.searchsorted(known, ask), len(known) - 1)
        found = np.where(known[slot] == ask, rank[at], width)
        out[a:a + PAIRS] = np.minimum.reduceat(found, first) == here[a:a + PAIRS]
    return out


def _shared(i, j, grams, edge):
    """Sizes of the intersections of pairs of one unit."""
    if len(i) <= 40:
        return np.array([len(np.intersect1d(grams[edge[a]:edge[a + 1]], grams[edge[b]:edge[b + 1]], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    rows = np.unique(np.concatenate((i, j)))
    flat = np.concatenate([grams[edge[r]:edge[r + 1]] for r in rows])
    owner = np.repeat(np.arange(len(rows)), edge[rows + 1] - edge[rows])
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # members of one set only cannot be shared
    keep = times[at] > 1
    at, owner = number[at[keep]], owner[keep]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        part = (at >= low) & (at < low + 4096)
        held = np.zeros((len(rows), 4096), np.float32)
        held[owner[part], at[part] - low] = 1
        total += held @ held.T
    return total[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


def _meet(similarity, verify):
    """Sets that have a pair of their own in a bucket; with ``verify``, the links found there."""

    def meet(table: pa.Table) -> pa.Table:
        found = met(table)
        batches.release()
        return found

    def met(table):
        at = table.schema.get_field_index("leaves")
        table = table.set_column(at, "leaves", table["leaves"].cast(pa.list_(pa.int64()))).combine_chunks()
        bucket, one, two, own, size = (table[c].to_numpy() for c in ("bucket", "one", "two", "own", "size"))
        leaves, rank, edge = _ranks(table["leaves"])
        order = np.lexsort((two, one, bucket))
        key = np.stack((bucket, one, two))[:, order]
        new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        copies = table["copies"].to_numpy()
        if verify:
            lists = table["grams"].combine_chunks()
            starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            grams = lists.flatten().to_numpy()
        width = len(leaves) + 1
        known = np.sort(np.repeat(np.arange(len(bucket)), np.diff(edge)) * width + rank)
        here = np.searchsorted(leaves, bucket)
        kept, links, root = [], [], []

        def settle(units):
            """Keep the pairs that belong here, of several units at once; then go through the units."""
            if not units:
                return
            i, j = (np.concatenate(x) for x in zip(*units))
            mine = _first_common(i, j, here[i], rank, edge, known, width)
            end = 0
            for p, q in units:
                start, end = end, end + len(p)
                p, q = p[mine[start:end]], q[mine[start:end]]
                if verify and len(p):
                    shared = _shared(p, q, grams, starts)
                    alike = shared >= similarity * (size[p] + size[q] - shared)
                    p, q = p[alike], q[alike]
                if len(p):
                    take(p, q)

        def take(i, j):
            inside, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            kept.append(inside)
            if verify:
                p, q = at[:len(i)], at[len(i):]
                links.append((np.bincount(p, weights=copies[j], minlength=len(inside)) + np.bincount(q, weights=copies[i], minlength=len(inside))).astype(np.int64))
                label, last = np.arange(len(inside)), None
                while last is None or (label != last).any():
                    last, low = label, np.minimum(label[p], label[q])
                    label = label.copy()
                    np.minimum.at(label, p, low)
                    np.minimum.at(label, q, low)
                    label = label[label]
                root.append(inside[label])

        waiting, number = [], 0
        for a, b in zip(new, np.append(new[1:], len(order))):
            rows = order[a:b]
            i, j = _pairs(rows, one[rows[0]] != two[rows[0]], own, size, similarity)
            if len(i):
                waiting.append((i, j))
                number += len(i)
            if number >= PAIRS:
                settle(waiting)
                waiting, number = [], 0
        settle(waiting)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        sid = table["sid"].take(pa.array(flat))
        if not verify:
            return pa.table({"sid": sid, **{c: table[c].take(pa.array(flat)) for c in ("bucket", "one", "two", "own", "size", "copies", "leaves")}})
        return pa.table({"sid": sid, "root": table["sid"].take(pa.array(np.concatenate(root) if root else flat)), "links": np.concatenate(links) if links else flat})

    return meet


def text_id(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _among(rows: DataFrame, wanted: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows whose ``text_id`` has its hash in a bitmap (of ``cells`` bits at most) of the wanted ones: all of these, few others."""
    cell = F.pmod(F.xxhash64("text_id"), F.lit(cells))
    bits = wanted.groupBy(F.bitmap_bucket_number(cell).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits"))
    at = F.bitmap_bit_position(cell).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number(cell) == F.col("_part"))
    return held.filter(F.call_function("getbit", byte, at % 8) == 1).select(rows.columns)


def _members_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Each wanted ``text_id`` as the set of its text (``grams``), with the other columns of ``wanted``."""
    wanted = written(wanted, "wanted")
    cells = min(CELLS, max(1 << 15, 16 * wanted.count()))
    texts = _among(docs.select(text_id().alias("text_id"), "text"), wanted, cells).groupBy("text_id").agg(F.first("text").alias("text"))
    rows = texts.join(wanted, "text_id").select("text", *[c for c in wanted.columns if c != "text_id"])
    schema = ", ".join(["grams array<long>", *[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]]])
    return rows.mapInArrow(_members(k), schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), by alternating star rounds."""
    def both(e):
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        around = both(edges)
        low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = mark


def classes(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, again: int = AGAIN) -> DataFrame:
    """doc_id, text_id, class_id and n_links (other documents of the wanted similarity) of every document."""
    runs = max(1, math.ceil(math.log(1 - recall) / -1.0))
    rows = written(docs.select("doc_id", text_id().alias("text_id"), "text").mapInArrow(_describe(k, similarity, runs), "doc_id long, text_id binary, sid binary, size long, picks array<long>"), "picks")
    sets = written(rows.filter("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("text_id").alias("text_id"), F.first("size").alias("size"), F.first("picks").alias("picks")), "sets")

    def met(found):
        number = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return written(found.join(number, "bucket").select("sid", "bucket", "n"), "buckets")

    leaves = met(sets.select("sid", F.explode(F.array_distinct("picks")).alias("bucket")))
    large = leaves.filter(F.col("n") > small)
    if not large.isEmpty():
        # sets that are alike have mostly the same smallest pick; splitting them again would only repeat them
        lows = large.join(sets.select("sid", F.array_min("picks").alias("low")), "sid").groupBy("bucket", "low").agg(F.count(F.lit(1)).alias("same"), F.first("n").alias("n"))
        alike = written(lows.groupBy("bucket").agg((F.max("same") > F.max("n") / 2).alias("alike")).filter("alike").select("bucket"), "alike")
        stay, large = large.join(alike, "bucket", "left_semi").select(large.columns), large.join(alike, "bucket", "left_anti")
        wanted = sets.select("sid", "text_id").join(large.groupBy("sid").agg(F.collect_list("bucket").alias("places")), "sid")  # a few picks for each run
        again_ = _members_of(docs, wanted, k).select("sid", F.explode("places").alias("bucket"), "grams").mapInArrow(_split(similarity, again), "sid binary, bucket long").distinct()
        leaves = written(leaves.filter(F.col("n") <= small).unionByName(stay).unionByName(met(again_)), "leaves")
    lists = leaves.groupBy("sid").agg(F.array_sort(F.collect_list("bucket")).alias("leaves"))  # a few picks for each run
    blocks = F.when(F.col("n") <= small, F.lit(1)).otherwise(F.ceil(F.col("n") / block)).cast("int")
    placed = (leaves.join(lists, "sid").join(sets.select("sid", "size", "copies"), "sid").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("sid", "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "size", "copies", "leaves"))
    unit = "sid binary, bucket long, one int, two int, own int, size long, copies long, leaves array<long>"

    def chunked(df, per_chunk):
        chunks = max(1, leaves_rows // per_chunk)
        return df.groupBy(F.pmod(F.xxhash64("bucket", "one", "two"), F.lit(chunks)).alias("chunk"))

    leaves_rows = leaves.count()
    paired = written(chunked(placed, 4 * CHUNK_ROWS).applyInArrow(_meet(similarity, False), unit), "paired")
    places = paired.groupBy("sid").agg(F.collect_list(F.struct("bucket", "one", "two", "own")).alias("places"), *[F.first(c).alias(c) for c in ("size", "copies", "leaves")])
    members = _members_of(docs, sets.select("sid", "text_id").join(places, "sid"), k)
    leaves_rows = paired.count()
    linked = written(chunked(members.select("sid", F.inline("places"), "size", "copies", "leaves", "grams"), CHUNK_ROWS).applyInArrow(_meet(similarity, True), "sid binary, root binary, links long"), "linked")
    roots = components(linked.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    known = sets.select("sid", "copies").join(links, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = rows.select("doc_id", "text_id", "sid").join(known, "sid", "left")
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "root", "left").select(
        "doc_id", "text_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")


def join(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, class_id, n_links."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links")


def distinct(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id (then text) stays."""
    found = classes(docs, **options)
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("text_id").alias("text_id"))
    first = found.filter("root is not null").groupBy("root").agg(F.min(place).alias("at")).select("at.doc_id", "at.text_id")
    texts = docs.withColumn("_text_id", text_id())
    alone = texts.filter(~F.exists(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    held = texts.alias("t").join(first.withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"}), (F.col("_text_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return held.dropDuplicates(["_text_id", "_doc"]).select("t.*").unionByName(alone).drop("_text_id")


SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
g as (
  select distinct r, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
z as (select r, count(*) as n from g group by r),
p as (select a.r as x, b.r as y, count(*) as c from g a join g b on a.s = b.s and a.r < b.r group by a.r, b.r),
l as (select x, y from p join z a on a.r = p.x join z b on b.r = p.y where c >= 0.8::double * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
walk as (select x, y from e union select walk.x, e.y from walk join e on walk.y = e.x),
class as (select x as r, min(doc_id) as low from walk join d on d.r = walk.y group by x),
many as (select x as r, count(*) as n from e group by x)
select doc_id, least(doc_id, low) as class_id, coalesce(n, 0)::bigint as n_links from d left join class using (r) left join many using (r)
"""
