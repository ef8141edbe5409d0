"""Hard negatives by slot-decomposed selection.

Every anchor has a few positives, and every positive opens a window of scores in
which its negatives lie: a share ``low`` to a share ``high`` of the positive's
own score.  The upper limits of an anchor's windows split all scores into
disjoint slots.  Tasks keep the best ``negatives`` rows of each slot, a window
with a group limit combines them, and as the slots are ordered, the rows below
any upper limit are the slots from its own one downwards: one descending merge
of these few rows answers every window of the anchor, overlapping or not.

Anchors are a stated query set.  Rows and anchors are packed into blocks of
integer vectors, anchors are sent to every block of rows, and a pair of blocks is
one matrix product.  What a pair returns is bounded by its anchors (one row a slot
place), so a label or a vector that a third of all rows share changes nothing.
The work is anchors times rows by nature; at 30 GB and the query's one anchor in
fifty rows the anchors are shuffled about 300 times.

Scores are integers: each component becomes floor(``scale`` * x) and a score is the
exact inner product (float32 and float64 products are used only where they are
exact).  Vectors of unlike length meet in the components that both have.

Defined results: rows without label, without vector, with a null or non-finite
component, or so long that the score limits would leave 64 bits (a squared norm of
4e17 at the default limits) take no part; null ids are never anchors and come last
among ties; repeated rows count one by one, an anchor only leaves out itself, and
repeated anchors answer one by one; an anchor without positives, and a positive
whose window is empty (every negative score among them), has no rows; empty tables
give no rows; other columns of the input are not used.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dailybars.plans.cut import written

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 3
LOW = (50, 100)
HIGH = (95, 100)
PACK_ROWS = 8192
MOST_ROWS = 1 << 18
CELLS = 1 << 21

PACKS = "pack bigint, anchors boolean, payload binary"


def _reduced(share: tuple[int, int]) -> tuple[int, int]:
    by = gcd(*share)
    return share[0] // by, share[1] // by


def whole(column, scale: float, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of a list column as one matrix, and which rows take part."""
    n = len(column)
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    bad = np.asarray(values.is_null())
    x = np.floor(np.asarray(values.fill_null(0).cast(pa.float64())) * scale)
    offsets = offsets - offsets[0]
    bad |= ~np.isfinite(x) | (np.abs(x) >= 2.0 ** 31)
    of = np.repeat(np.arange(n), np.diff(offsets))
    x[bad] = 0
    fits = np.bincount(of, weights=x * x, minlength=n) * room < 2.0 ** 62
    kept = np.asarray(column.is_valid()) & fits & (np.bincount(of, weights=bad, minlength=n) == 0)
    out = np.zeros((n, int(np.diff(offsets).max(initial=0))), np.int32)
    out[of, np.arange(len(of)) - offsets[of]] = x
    return out, kept


def _payload(ids: pa.Array, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    if np.abs(vectors).max(initial=0) < 1 << 15:
        vectors = vectors.astype(np.int16)
    table = pa.table({"id": ids, "label": labels, "vector": pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(vectors.shape[1] * vectors.itemsize), len(labels), [None, pa.py_buffer(np.ascontiguousarray(vectors))])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema.with_metadata({"type": vectors.dtype.str}), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _open(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a pack."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    kind = np.dtype(table.schema.metadata[b"type"].decode())
    column = table["vector"].chunk(0)
    wide = column.type.byte_width // kind.itemsize
    return table["id"].chunk(0), table["label"].to_numpy(), np.frombuffer(column.buffers()[1], kind, len(column) * wide).reshape(len(column), wide)


def _packs(scale, room, most):
    """Packs of at most ``most`` rows of one task, ordered by id, and packs of the anchors among them."""
    def flush(held, number):
        width = max(v.shape[1] for *_, v in held)
        ids = pa.concat_arrays([i for i, *_ in held])
        labels, anchor = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        vectors = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for *_, v in held])
        order = pc.sort_indices(ids)  # nulls last
        ids, order = ids.take(order), order.to_numpy()
        for anchors, at in ((False, order), (True, order[anchor[order]])):
            if len(at):
                kept = ids.filter(pa.array(anchor[order])) if anchors else ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([2 * number + anchors], pa.int64()), pa.array([anchors]), pa.array([_payload(kept, labels[at], vectors[at])], pa.binary())],
                    names=["pack", "anchors", "payload"])

    def pack(batches):
        held, n, number = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                vectors, kept = whole(part.column("embedding"), scale, room)
                kept &= np.asarray(part.column("label").is_valid())
                if not kept.any():
                    continue
                if n and n + kept.sum() > most:
                    yield from flush(held, number)
                    held, n = [], 0
                if not n:
                    number = part.column("row")[0].as_py()
                mask = pa.array(kept)
                held.append((part.column("vec_id").filter(mask), part.column("label").filter(mask).to_numpy(),
                             np.asarray(part.column("anchor").filter(mask)), vectors[kept]))
                n += int(kept.sum())
        if n:
            yield from flush(held, number)

    return pack


def _product(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products as integers of 64 bits."""
    wide = min(a.shape[1], r.shape[1])
    a, r = a[:, :wide], r[:, :wide]
    bound = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(r.astype(np.int64)).max(initial=0)) * max(wide, 1)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ r.astype(kind).T).astype(np.int64)


def best(score: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best masked entries of every row; ties go to the smaller column."""
    n, m = score.shape
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = int(score.min()), int(score.max())
    if (high - low + 2) * m < 1 << 62:
        key = np.where(mask, (score - low) * m + np.arange(m - 1, -1, -1), -1)
        take = np.argpartition(key, m - k, axis=1)[:, m - k:] if k < m else np.tile(np.arange(m), (n, 1))
        rows = np.repeat(np.arange(n), take.shape[1])
        columns = take.ravel()
        held = key[rows, columns] >= 0
        return rows[held], columns[held]
    rows, columns = [], []
    for i in range(n):
        at = np.flatnonzero(mask[i])
        at = at[np.lexsort((at, -score[i, at]))][:k]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


FOUND = "pack bigint, place int, slot int, score bigint, id bigint"


def _limits(limits: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of the slots of n anchors; unused slots are empty."""
    wide = max((len(x["slots"]) for x in limits), default=0)
    low, high = np.ones((n, wide), np.int64), np.zeros((n, wide), np.int64)
    for x in limits:
        for slot, s in enumerate(x["slots"]):
            low[x["place"], slot], high[x["place"], slot] = s["low"], s["high"]
    return low, high


def _pairs(k):
    """The best rows of a pair of blocks: of the anchor's own label, or of each slot if the anchors carry ``limits``."""
    def find(batches):
        last = (None, None)
        for batch in batches:
            for pair in batch.to_pylist():
                if last[0] != pair["rows_pack"]:
                    last = (pair["rows_pack"], _open(pair["rows"]))
                ids, label, vectors = last[1]
                _, own, anchors = _open(pair["payload"])
                low, high = _limits(pair["limits"], len(own)) if "limits" in pair else (None, None)
                out = []
                step = max(1, CELLS // max(len(label), 1))
                for at in range(0, len(own), step):
                    score = _product(anchors[at:at + step], vectors)
                    alike = own[at:at + step, None] == label[None, :]
                    for slot in range(1 if low is None else low.shape[1]):
                        mask = alike if low is None else ~alike & (score >= low[at:at + step, slot, None]) & (score <= high[at:at + step, slot, None])
                        row, column = best(score, mask, k)
                        out.append((row + at, np.full(len(row), slot), score[row, column], column))
                if out:
                    place, slot, score, column = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), pair["pack"]), pa.int64()), pa.array(place, pa.int32()), pa.array(slot, pa.int32()),
                         pa.array(score, pa.int64()), ids.take(pa.array(column))], names=["pack", "place", "slot", "score", "id"])

    return find


def _themselves(batches):
    for batch in batches:
        for pack in batch.to_pylist():
            ids, _, vectors = _open(pack["payload"])
            v = vectors.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), pack["pack"]), pa.int64()), pa.array(np.arange(len(v)), pa.int32()), ids, pa.array((v * v).sum(1), pa.int64())],
                names=["pack", "place", "anchor_id", "self"])


def _combined(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every (anchor, slot) over all blocks."""
    order = W.partitionBy("pack", "place", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW,
         high: tuple[int, int] = HIGH, scale: float = SCALE, pack_rows: int = PACK_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Negatives of each anchor and positive among ``rows`` (vec_id, embedding, label); ``anchor`` marks the anchors.

    Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score with low * positive <= negative <= high * positive.
    """
    spark = rows.sparkSession
    (low_by, low_of), (high_by, high_of) = _reduced(low), _reduced(high)
    plain = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    blocks = max(1, -(-rows.count() // pack_rows))
    numbered = plain.coalesce(blocks).withColumn("row", F.monotonically_increasing_id())
    packs = written(numbered.mapInArrow(_packs(scale, max(low_by, low_of, high_by, high_of), most_rows), PACKS), "packs")
    of_rows = packs.filter("not anchors").select(F.col("pack").alias("rows_pack"), F.col("payload").alias("rows"))
    asked = packs.filter("anchors").select("pack", "payload")
    numbers = [r[0] for r in of_rows.select("rows_pack").collect()]  # one number a block of rows

    def against_all(asked: DataFrame, k: int) -> DataFrame:
        everywhere = asked.withColumn("rows_pack", F.explode(F.from_json(F.lit(str(numbers)), "array<bigint>")))
        return _combined(everywhere.join(of_rows, "rows_pack").mapInArrow(_pairs(k), FOUND), k)

    entry = F.struct((-F.col("score")).alias("order"), F.col("id").isNull().alias("last"), "id", "score", "slot")
    anchors = asked.mapInArrow(_themselves, "pack bigint, place int, anchor_id bigint, self bigint")
    alike = against_all(asked, positives + 1).groupBy("pack", "place").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    own = F.array_position(F.transform("near", lambda x: (x["score"] == F.col("self")) & x["id"].eqNullSafe(F.col("anchor_id"))), True)
    wanted = (alike.join(anchors, ["pack", "place"]).withColumn("own", own)
                   .select("pack", "place", "anchor_id", F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, positives).alias("near"))
                   .select("pack", "place", "anchor_id", F.expr(f"""transform(filter(near, p -> p.score >= 0), p -> struct(
                       p.id as id, p.score as score, (p.score * {low_by}L + {low_of - 1}L) div {low_of}L as low, (p.score * {high_by}L) div {high_of}L as high))""").alias("wanted"))
                   .withColumn("tops", F.expr("array_sort(array_distinct(wanted.high), (a, b) -> cast(sign(b - a) as int))"))
                   .withColumn("slots", F.expr("""transform(tops, (u, i) -> struct(
                       greatest(get(tops, i + 1) + 1, array_min(transform(filter(wanted, w -> w.high >= u), w -> w.low))) as low, u as high))""")))
    wanted = written(wanted, "windows")
    limits = wanted.groupBy("pack").agg(F.collect_list(F.struct("place", "slots")).alias("limits"))
    slots = against_all(asked.join(limits, "pack"), negatives).groupBy("pack", "place").agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    merged = (wanted.drop("slots").join(slots, ["pack", "place"]).withColumn("w", F.explode("wanted"))
                    .select("anchor_id", "w", F.posexplode(F.expr(
                        f"slice(filter(slots, x -> x.slot >= array_position(tops, w.high) - 1 and x.score >= w.low), 1, {negatives})")).alias("at", "n")))
    return merged.select("anchor_id", F.col("w.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                         F.col("w.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 50, shift: int = 7, labels: int = 10, **options) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by ``every``; labels of ids divisible by ``shift`` move on by one first."""
    label = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % every == 0, **options)


SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as c
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as alike, list_dot_product(a.c, b.c)::bigint as score
  from v a, v b where a.vec_id % 50 = 0 and a.r <> b.r),
p as (
  select r, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, id nulls last) as nth
  from s where alike qualify nth <= 5),
n as (
  select p.r, p.nth, p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
         row_number() over (partition by p.r, p.nth order by s.score desc, s.id nulls last) as rank
  from p join s on p.r = s.r and not s.alike
  where 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
  qualify rank <= 3)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n
"""
