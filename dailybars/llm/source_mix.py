"""Mixing overlapping sources to target weights by minimum-cost flow.

A document may belong to several sources.  Documents with the same set of sources
form one *pattern*; only patterns, with their total words, are looked at by the
flow: words run from patterns to the sources they belong to, up to each source's
target.  Taking a pattern's words a first, second, third time costs 0, 1, 2 a word
(convex, so repeats are spread), and no pattern gives more than ``REPEATS`` times
its words.  A pattern that gives F of its S words repeats every document F // S
times; the rest goes to whole documents in a seeded order, until the next one
would exceed it.  With ``fill`` every later document that still fits is taken too,
so a large one at the edge costs no more than itself (the SQL stops at the edge).

The flow is solved on the driver: there are at most ``PATTERNS`` patterns, more are
an error (they are combinations of source labels, not documents).  Documents are
picked on Spark: the seeded order is cut into 65,536 cells per pattern, whose word
counts show the cell where the rest ends; only that cell's documents are ordered.

Defined results: null texts have size 0 and are taken 0 words; a null source is a
source of its own, last in order; a document without sources is never taken;
rows with equal id and text follow each other in the seeded order, repeated rows
are picked one by one; no rows give no rows; if all sizes are 0 nothing is taken.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from dailybars.plans.cut import written

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 20
PATTERNS = 20_000
CELL_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of all words by weight, none above ``repeats`` times its source; the excess is shared again."""
    left, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / whole > repeats * sizes[s]]
        if not full:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in full:
            out[s] = float(repeats * sizes[s])
            del open_[s]
        left -= sum(out[s] for s in full)
    return out


def flow(patterns: list, totals: list, quotas: dict, repeats: int = REPEATS) -> list:
    """Words each pattern gives, by shortest augmenting paths in a residual graph with potentials."""
    arcs, heads = [], []  # an arc and its reverse are neighbours: [to, room, cost]
    def node():
        heads.append([])
        return len(heads) - 1
    def arc(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            heads[x].append(len(arcs))
            arcs.append([y, r, c])
        return len(arcs) - 2
    start, end = node(), node()
    sources = {s: node() for s in quotas}
    for s, q in quotas.items():
        arc(sources[s], end, q, 0)
    given = []
    for members, total in zip(patterns, totals):
        p = node()
        given.append([arc(start, p, total, k) for k in range(repeats)])
        for s in members:
            arc(p, sources[s], total * repeats, 0)
    height = [0] * len(heads)
    while True:
        cost, by = {start: 0}, {}
        queue, done = [(0, start)], set()
        while queue:
            c, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for i in heads[a]:
                b, room, price = arcs[i]
                if room and (new := c + price + height[a] - height[b]) < cost.get(b, float("inf")):
                    cost[b], by[b] = new, i
                    heapq.heappush(queue, (new, b))
        if end not in done:
            break
        far = cost[end]
        height = [h + min(cost.get(i, far), far) for i, h in enumerate(height)]
        path, at = [], end
        while at != start:
            path.append(by[at])
            at = arcs[by[at] ^ 1][0]
        much = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= much
            arcs[i ^ 1][1] += much
    return [sum(arcs[i ^ 1][1] for i in own) for own in given]


def _filled(rows: DataFrame) -> DataFrame:
    """Marks the documents that fit one after the other into the rest of their pattern.

    A round takes, in order, what is no larger than the room left, up to the first that
    exceeds it together with the others; the next begins behind that one.  What a round
    passed over is larger than its room and so than every later one.
    """
    spark = rows.sparkSession
    at = F.struct("place", "row")
    state = [(r["p"], None, r["rest"]) for r in rows.filter("rest > 0").select("p", "rest").distinct().collect()]  # one row a pattern
    rounds = {p: [] for p, _, _ in state}
    kind = "struct<place:long,row:long>"
    while state:
        now = F.broadcast(spark.createDataFrame(state, f"p string, low {kind}, room long"))
        fit = rows.select("p", "cell", "place", "row", "size").join(now, "p").filter((F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("low").isNull() | (at > F.col("low"))))
        cells = fit.groupBy("p", "cell", "room").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("p").orderBy("cell"))
        last = F.broadcast(cells.withColumn("upto", upto).filter(F.col("upto") > F.col("room")).groupBy("p").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("edge")))
        running = F.col("edge.before") + F.sum("size").over(Window.partitionBy("p").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0))
        over = fit.join(last, "p").filter("cell = edge.cell").withColumn("running", running).filter(F.col("running") > F.col("room"))
        edges = {r["p"]: r["e"] for r in over.groupBy("p").agg(F.min_by(F.struct("place", "row", (F.col("running") - F.col("size")).alias("used")), at).alias("e")).collect()}
        following = []
        for p, low, room in state:
            edge = edges.get(p)
            high = edge and (edge["place"], edge["row"])
            rounds[p].append((low, high, room))
            if edge and room > edge["used"]:
                following.append((p, high, room - edge["used"]))
        state = following
    plan = F.broadcast(spark.createDataFrame(list(rounds.items()), f"p string, rounds array<struct<low:{kind},high:{kind},room:long>>"))
    taken = F.exists("rounds", lambda r: (F.col("size") <= r["room"]) & (r["low"].isNull() | (at > r["low"])) & (r["high"].isNull() | (at < r["high"])))
    return rows.join(plan, "p", "left").withColumn("picked", F.coalesce(taken, F.lit(False)))


def mix(docs: DataFrame, members: str, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, carry: tuple = (), fill: bool = False) -> tuple[DataFrame, dict, dict]:
    """Every document with its size and the words taken; sizes and targets of the sources.

    ``members`` names a column of arrays of sources; ``weights`` repeat over the sources
    by code point, null last; ``carry`` names columns to keep in a struct ``kept``.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 15), 16, 10).cast("long")
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept")] if carry else []
    sized = written(docs.select("doc_id", F.array_sort(F.array_distinct(members)).alias("pattern"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"), order.alias("place"), *kept, *[F.monotonically_increasing_id().alias("row")] * fill), "mix-sizes")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} combinations of sources")
    sizes: dict = {}
    for row in found:
        for s in row["pattern"] or ():
            sizes[s] = sizes.get(s, 0) + row["words"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, repeats)
    patterns = [tuple(r["pattern"] or ()) for r in found]
    words = [r["words"] if p else 0 for r, p in zip(found, patterns)]
    got = flow(patterns, words, {s: int(g + 0.5) for s, g in goal.items()}, repeats)
    plan = spark.createDataFrame([(r["pattern"], f // w if w else 0, f % w if w else 0) for r, w, f in zip(found, words, got)], "pattern array<string>, times long, rest long")
    named = F.to_json(F.struct("pattern"))
    plan = F.broadcast(plan.select(named.alias("p"), "times", "rest"))  # at most PATTERNS rows
    rows = sized.withColumn("p", named).withColumn("cell", F.shiftright("place", 60 - CELL_BITS)).join(plan, "p", "left")
    copies = F.when(F.col("size") > 0, F.coalesce("times", F.lit(0)) + F.when(F.col("picked") & (F.col("rest") > 0), 1).otherwise(0)).otherwise(0).cast("long")
    result = ["doc_id", "pattern", "size", (copies * F.col("size")).alias("taken"), copies.alias("times"), *["kept"] * bool(carry)]
    if fill:
        return _filled(rows).select(result), sizes, goal
    cells = rows.groupBy("p", "cell", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("p").orderBy("cell"))
    last = F.broadcast(cells.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy("p", "rest").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("at"))
                       .select("p", F.col("at.cell").alias("edge"), F.col("at.before").alias("before")))  # one row a pattern
    rows = rows.join(last, "p", "left")
    running = F.col("before") + F.sum("size").over(Window.partitionBy("p").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.filter("cell = edge").withColumn("picked", running <= F.col("rest"))
    others = rows.filter("edge is null or cell <> edge").withColumn("picked", F.coalesce(F.col("cell") < F.col("edge"), F.lit(True)))
    return others.unionByName(edge).select(result), sizes, goal


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, fill: bool = True, carry: tuple = ()) -> DataFrame:
    """The mix of documents that name one source each: doc_id, size, source_size, target, taken, times and the columns to carry.

    A carried column named like one of the first gets ``_of_document`` behind its name.
    """
    spark = docs.sparkSession
    members = "members"
    while members in docs.columns:
        members += "_"
    mixed, sizes, goal = mix(docs.withColumn(members, F.array("source")), members, weights, repeats, seed, carry=carry, fill=fill)
    own = ["doc_id", "size", "source_size", "target", "taken", "times"]
    known = F.broadcast(spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], "name string, source_size long, target double"))
    return mixed.join(known, F.col("pattern")[0].eqNullSafe(F.col("name")), "left").select(
        *own, *[F.col(f"kept.`{c}`").alias(f"{c}_of_document" if c in own else c) for c in carry])


SQL = r"""
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5('20:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as place
  from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nr from sized group by source),
weighed as (select *, case (nr - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3.0::double * source_size as most from sources),
ranked as (
  select *, sum(most) over o - most as full_before, sum(w) over () - (sum(w) over o - w) as w_left, sum(source_size) over () as total
  from weighed window o as (order by most / w, nr rows unbounded preceding)),
levels as (select *, (total - full_before) / w_left as level, row_number() over (order by most / w, nr) as rank from ranked),
final as (select arg_min(level, rank) filter (where level * w <= most) as level from levels),
goals as (select source, source_size, least(most, coalesce(final.level, 0) * w)::double as target from levels, final),
asked as (select *, floor(target + 0.5)::bigint as words from goals),
placed as (
  select s.doc_id, s.source, s.size, g.source_size, g.target, case when g.source_size = 0 then 0 else g.words // g.source_size end as whole,
         case when g.source_size = 0 then 0 else g.words % g.source_size end as rest,
         row_number() over (partition by s.source order by s.place, s.doc_id) as nr
  from sized s join asked g on s.source is not distinct from g.source),
filled as (
  select *, case when size between 1 and rest then 1 else 0 end as picked from placed where nr = 1
  union all
  select p.doc_id, p.source, p.size, p.source_size, p.target, p.whole, f.rest - f.picked * f.size, p.nr,
         case when p.size between 1 and f.rest - f.picked * f.size then 1 else 0 end
  from filled f join placed p on p.source is not distinct from f.source and p.nr = f.nr + 1)
select doc_id, size, source_size, target, cast((whole + picked) * size as bigint) as taken,
       cast(case when size > 0 then whole + picked else 0 end as bigint) as times
from filled
"""
