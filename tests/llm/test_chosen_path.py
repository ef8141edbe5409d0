import numpy as np
import pytest
from pyspark.sql import functions as F

from dailybars.llm import chosen_path


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = np.random.default_rng(11)
    prose = lambda n: list(rng.choice([f"w{i}" for i in range(3000)], n))
    passage, texts = prose(40), [None, "", " \n", "one two", "one  TWO", "one two three"]
    for _ in range(40):
        base = prose(rng.integers(30, 200))
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 6):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join(prose(60) + passage + prose(60)) for _ in range(60)]  # a passage that many share
    base = prose(120)
    for i in range(50):  # many near copies of one text
        copy = list(base)
        copy[rng.integers(0, 120)] = f"only{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(prose(20_000))] * 2
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (20, texts[20]), (None, "")]


@pytest.mark.parametrize("options", [{}, {"small": 10, "block": 8}])
def test_against_all_pairs(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sid string")
    got = sorted((tuple(r) for r in chosen_path.join(docs, **options).collect()), key=str)
    assert got == expected(rows)


def test_one_of_each_class(spark):
    rows = corpus()[:80] + [(7, corpus()[7][1])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, root string")
    kept = chosen_path.distinct(docs)
    want = [r for r in expected(rows) if r[0] == r[1] or not shingles(dict(rows)[r[0]])]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in want})
    assert chosen_path.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1 << 26, 7])
def test_only_texts_that_may_be_wanted_are_shuffled(spark, cells):
    rows = spark.range(400).select(chosen_path.text_id(F.col("id").cast("string")).alias("text_id"), "id")
    kept = {r["id"] for r in chosen_path._among(rows, rows.filter("id % 10 = 0").select("text_id"), cells).collect()}
    assert kept >= set(range(0, 400, 10)) and (cells == 7 or len(kept) == 40)
    assert chosen_path._among(rows, rows.limit(0).select("text_id")).count() == 0
