"""I-Match fingerprints over random subsets of a lexicon, with DataFrame functions only.

The lexicon holds the terms (distinct lower-cased words) whose document frequency
lies in a band: between ``LOW`` and ``HIGH`` of all documents, and high enough that at
most ``LEXICON`` terms can pass (a term in the band takes at least its lower bound
of all postings), so the lexicon has a proven bound and is broadcast.  It is cut into
``SUBSETS`` random parts.  For each part the sorted terms of a document that are in
it are hashed; the fingerprint lists these hashes with the number of their part.
Two fingerprints are alike by the share of their parts that agree, of the parts
that either has.  A document without lexicon terms has the hash of all its terms.

Documents are dealt out by chunks of ``CHUNK`` following ids; the first document of
the next chunk comes along as a guest, so each document meets its successor, and
the terms are exploded, looked up and regrouped without another shuffle.

Defined results: null texts are empty; documents are ordered by doc_id, nulls last,
equal ids by text (equal rows are each other's successors); a single document is
its own successor; rows with one doc_id, or null, share a chunk; no rows give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dailybars.plans.cut import bucketed, written

LOW = 0.002
HIGH = 0.02
LEXICON = 1 << 18
SUBSETS = 64
CHUNK = 256
SEED = 17
BLANK = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), BLANK), lambda w: w != ""))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, most: int = LEXICON) -> DataFrame:
    """Terms of the band with the number of their subset."""
    counts = written(docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    sizes = counts.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    number = docs.count()
    least = max(low * number, sizes["postings"] / most)
    return counts.filter(F.col("df").between(least, high * number)).select("term", (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), "term")), 1, 8), 16, 10).cast("long") % SUBSETS).cast("int").alias("part"))


def _following(chunks: DataFrame) -> DataFrame:
    """(chunk, next) in ascending order, the last followed by the first; ordered within groups, then the groups."""
    grouped = chunks.withColumn("g", F.floor(F.col("chunk") / 1024))
    inner = grouped.withColumn("next", F.lead("chunk").over(Window.partitionBy("g").orderBy("chunk")))
    firsts = grouped.groupBy("g").agg(F.min("chunk").alias("first"))
    order = Window.orderBy("g")  # one row for 1024 * CHUNK ids
    turn = firsts.withColumn("after", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inner.join(turn.select("g", "after"), "g").select("chunk", F.coalesce("next", "after").alias("next"))


def _together(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` by chunk, with joins on (chunk, place) left where both sides already lie by chunk."""
    conf, key = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return bucketed(df, "chunk", name, dealt=True)
    finally:
        conf.set(key, before)


def _hashes(parts: Column) -> Column:
    """The fingerprint as an array: one entry for each subset with terms."""
    return F.transform(parts, lambda p: F.concat(F.lpad(F.hex(p["part"]), 2, "0"), F.substring(F.md5(F.array_join(F.array_sort(p["terms"]), " ")), 1, 6)))


def likeness(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, most: int = LEXICON) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    known = F.broadcast(lexicon(docs, low, high, most))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("doc_id") / CHUNK), F.lit((1 << 63) - 1)).alias("chunk"))
    heads = written(rows.groupBy(F.col("chunk").alias("next")).agg(F.min(F.struct("doc_id", "text"))["text"].alias("text")), "heads")  # only heads are shuffled
    guests = written(_following(heads.select(F.col("next").alias("chunk"))).join(heads, "next").select(F.lit(None).cast("long").alias("doc_id"), "text", "chunk", F.lit(True).alias("guest")), "guests")
    guests = guests.filter("chunk is not null")  # as Spark adds for one side of the join below; so both sides are alike and share one exchange of the texts
    place = Window.partitionBy("chunk").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    placed = (rows.withColumn("guest", F.lit(False)).unionByName(guests)
              .withColumns({"place": F.row_number().over(place), "after": F.lead("text").over(place)}).filter(~F.col("guest"))
              .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("after").substr(F.lit(1), half))))
    both = placed.select("chunk", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("kind"), terms(F.col("edited")).alias("terms")))).alias("t"))
    looked = both.select("chunk", "place", F.col("t.kind").alias("kind"), F.explode("t.terms").alias("term")).join(known, "term")
    parts = looked.groupBy("chunk", "place", "kind", "part").agg(F.collect_list("term").alias("terms"))
    prints = parts.groupBy("chunk", "place").agg(*(F.array_sort(_hashes(F.collect_list(F.when(F.col("kind") == k, F.struct("part", "terms"))))).alias(n) for k, n in ((0, "own"), (1, "changed"))))
    all_terms = lambda c: F.array(F.md5(F.array_join(F.array_sort(terms(F.col(c))), " ")))
    filled = lambda n, c: F.when(F.size(n) > 0, F.col(n)).otherwise(all_terms(c))
    whole = placed.select("chunk", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited").join(prints, ["chunk", "place"], "left")
    made = _together(whole.select("chunk", "place", "doc_id", "n_chars", "edited_sha256", filled("own", "text").alias("own"), filled("changed", "edited").alias("changed")), "prints")
    starts = made.filter("place = 1").select(F.col("chunk").alias("next"), F.col("own").alias("over"))
    ends = _following(made.select("chunk").distinct()).join(starts, "next").select("chunk", "over")
    follow = F.coalesce(F.lead("own").over(Window.partitionBy("chunk").orderBy("place")), "over")
    return (made.join(ends, "chunk", "left").withColumn("follow", follow)
            .select("doc_id", "n_chars", "edited_sha256", F.array_join("own", " ").alias("fingerprint"), F.array_join("changed", " ").alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("follow")).alias("near_next")))


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls last, coalesce(text, '')) as rn, count(*) over () as n from documents),
e as (
  select a.rn, a.n, a.doc_id, length(a.text)::bigint as n_chars, a.text,
         substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) as edited
  from d a join d b on b.rn = a.rn % a.n + 1),
t as (
  select rn, n, kind, list_distinct(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as terms
  from (select rn, n, 0 as kind, text as x from e union all select rn, n, 1, edited from e)),
u as (select rn, n, kind, unnest(terms) as term from t),
f as (select term, count(*) as df, max(n) as n from u where kind = 0 group by term),
lexicon as (
  select term, ('0x' || substr(md5('17:' || term), 1, 8))::bigint % 64 as part
  from f where df between greatest(0.002 * n, (select sum(df) from f) / 262144) and 0.02 * n),
parts as (
  select rn, kind, printf('%02X', part) || substr(md5(string_agg(term, ' ' order by term)), 1, 6) as h
  from u join lexicon using (term) group by rn, kind, part),
own as (select rn, kind, list_sort(list(h)) as p from parts group by rn, kind),
prints as (
  select t.rn, t.n, t.kind, coalesce(own.p, [md5(array_to_string(list_sort(t.terms), ' '))]) as p from t left join own using (rn, kind))
select e.doc_id, e.n_chars, sha256(e.edited) as edited_sha256, array_to_string(a.p, ' ') as fingerprint, array_to_string(b.p, ' ') as edited_fingerprint,
       len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p)) as near_edited,
       len(list_intersect(a.p, c.p)) / len(list_distinct(a.p || c.p)) as near_next
from e join prints a on a.rn = e.rn and a.kind = 0 join prints b on b.rn = e.rn and b.kind = 1 join prints c on c.rn = e.rn % e.n + 1 and c.kind = 0
"""
