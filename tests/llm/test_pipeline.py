import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from dailybars.llm import personal_data, source_mix, subword_bag


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    folder = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(rng.choice([f"word{i}" for i in range(900)], n))
    items = [(i, prose(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.integers(20, 80))
        if i % 4 == 0:
            text += " you stupid idiotic moron " + prose(10)
        if i % 11 == 1:
            text += " " + items[i % 5][1] + " end"
        if i % 7 == 2:
            text += " mail me@x.org or 10.0.0.1"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s9", rows[i][4]) for i in (2, 3, 6)] + [(2000, None, "en", None, 0), (2001, "", None, "s1", 0), (None, prose(50), "en", "s1", None), (7, *rows[7][1:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = cp.toxicity(spark, docs, folder)
    kept = first.collect()
    toxic = {r[0] for r in rows if r[1] and "stupid" in r[1]}
    left = {r["doc_id"] for r in kept}
    assert first.columns == docs.columns and len(left & toxic) <= 0.1 * len(toxic) and len(left) >= 0.95 * len({r[0] for r in rows} - toxic)
    second = cp.near_duplicates(spark, docs, folder)
    ids = [r["doc_id"] for r in second.collect()]
    assert second.columns == docs.columns and sorted(x for x in ids if x is not None) == sorted({r[0] for r in rows if r[0] is not None} - {1002, 1003, 1006})
    third = cp.decontamination(spark, docs, folder)
    marked = {r[0] for r in rows if r[1] and any(t in r[1] for _, t in items)}
    assert third.columns == docs.columns and third.count() == sum(r[0] not in marked for r in rows)
    fourth = cp.privacy(spark, docs, folder)
    assert fourth.schema == docs.schema
    want = sorted((r[0], None if r[1] is None else personal_data.redact(r[1])) for r in rows if r[0] is not None)
    assert sorted((r["doc_id"], r["text"]) for r in fourth.collect() if r["doc_id"] is not None) == want
    assert fourth.filter(F.col("n_chars") != F.length("text")).isEmpty()
    fifth = cp.mixing(spark, docs, folder)
    assert fifth.filter("taken <= 0 or times > 3 or taken <> times * size").isEmpty()
    assert [c for c in docs.columns if c not in fifth.columns] == []
    texts = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in texts for r in fifth.collect())
    by_source = fifth.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 200 for r in by_source)


def test_run_and_no_rows(spark, tables, tmp_path):
    folder = tables[0]
    a, b = (sorted(map(str, cp.run(spark, folder).collect())) for _ in range(2))
    assert a and a == b
    empty = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).count() == 0


def test_columns_of_the_same_names_stay(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "7.5D as score", "'t' as toxicity", "1 as taken", "2 as size", "3 as members", "4 as kept", "5 as target")
    first = cp.toxicity(spark, docs, folder)
    assert first.schema == docs.schema and {(r["score"], r["toxicity"]) for r in first.collect()} == {(7.5, "t")}
    last = cp.mixing(spark, docs, folder)
    got = {(r["taken_of_document"], r["size_of_document"], r["target_of_document"], r["members"], r["kept"]) for r in last.collect()}
    assert got == {(1, 2, 5, 3, 4)} and last.filter("taken <> times * size").isEmpty()


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a nice day", 5.0), (1, "a nice day", 5.0), (None, None, 1.0), (3, "", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = subword_bag.toxicity(docs, none).collect()
    assert len(got) == 4 and all(r["score"] == pytest.approx(0, abs=1e-6) and r["predicted"] == 0 for r in got)


def test_held_out_accuracy():
    rng = np.random.default_rng(1)
    plain = lambda n: " ".join(rng.choice([f"w{a}{b}" for a in "abcdefgh" for b in "klmnopq"], n))
    make = lambda bad: plain(20) + (" " + rng.choice(bad) + " ") + plain(20)
    train, test = ["worthless", "pathetic", "disgusting"], ["w0rthless", "pathetics", "disgustingly"]
    texts = [make(train) if i % 2 else plain(40) for i in range(300)]
    model = subword_bag.fit(texts, [i % 2 for i in range(300)], 0.5)
    from dailybars.llm import batches
    import pyarrow as pa
    held = [make(test) if i % 2 else plain(40) for i in range(200)]
    cells, doc = subword_bag.subwords(*batches.utf8(pa.array(held)))
    score = model.score(cells, doc, 200)
    assert np.mean((score >= 0.5) == np.arange(200) % 2) > 0.9


def test_batches_of_a_stage_are_small(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 400) as text", "0L as n_chars")  # 6 MB

    def sizes(tables):
        for batch in tables:
            yield batch.set_column(0, "doc_id", pa.array([batch.nbytes] * len(batch), pa.int64()))

    monkeypatch.setattr(personal_data, "redacted", lambda docs: docs.mapInArrow(sizes, docs.schema))
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        assert cp.privacy(spark, docs, "").agg(F.max("doc_id")).first()[0] < 3 << 20
        spark.conf.set(key, str(1 << 20))  # a session's own value stays
        assert cp.privacy(spark, docs, "").agg(F.max("doc_id")).first()[0] < 3 << 19
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.set(key, before)
