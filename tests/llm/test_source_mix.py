from itertools import product

import pytest

from dailybars.llm import source_mix


def test_targets_and_flow():
    goal = source_mix.targets({"a": 10, "b": 1000, "c": 500}, {"a": 5, "b": 2, "c": 1})
    assert goal["a"] == 30 and sum(goal.values()) == pytest.approx(1510) and goal["b"] == pytest.approx(2 * goal["c"])
    patterns, totals, quotas = [("a",), ("a", "b"), ("b",)], [2, 2, 1], {"a": 5, "b": 3}
    cost = lambda give: sum(sum(range(k)) * t if t else 0 for g, t in zip(give, totals) for k in [0]) + sum(sum(min(max(g - k * t, 0), t) * k for k in range(3)) for g, t in zip(give, totals))
    best = None
    for a, ab_a, ab_b, b in product(range(7), range(7), range(7), range(4)):
        if ab_a + ab_b <= 6 and a + ab_a <= 5 and ab_b + b <= 3:
            give = (a, ab_a + ab_b, b)
            key = (-sum(give), cost(give))
            best = min(best or key, key)
    got = source_mix.flow(patterns, totals, quotas)
    assert (-sum(got), cost(got)) == best


def test_odd_rows(spark):
    assert source_mix.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (2, None, None, 9), (3, "one two", None, 9), (None, "w " * 5000, "y", 9), (5, "", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = [r.asDict() for r in source_mix.mix_sources(docs).collect()]
    assert len(got) == 6 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["source_size"] == 6 and by[1]["target"] == 18 and by[1]["taken"] == 9 and by[3]["taken"] == 6 and by[2]["size"] == 0
    assert source_mix.mix_sources(docs.filter("size = 0")).count() == 0


def test_overlap(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["a", "b"] if i % 2 else ["b"]) for i in range(300)]
    mixed, sizes, goal = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, members array<string>"), "members")
    got = mixed.collect()
    total = sum(r["taken"] for r in got)
    assert abs(total - sum(int(g + .5) for g in goal.values())) < 7 * 3 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, members array<string>"), "members")[0].collect()))


def test_fill(spark):
    rng = __import__("numpy").random.default_rng(5)
    rows = [(i, "w " * int(n), s) for s, low in (("a", 1), ("b", 1), ("c", 3)) for i, n in enumerate(rng.integers(low, 40, 60))]
    rows += [(100 + i, "w " * 900, s) for i, s in enumerate("aabbcc")] + [(7, "w " * 5, "a")] * 9 + [(None, None, "b"), (8, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    key = lambda r: (r["source_size"], r["doc_id"] is None, r["doc_id"] or 0, r["size"])
    short, full = (source_mix.mix_sources(docs, fill=fill).collect() for fill in (False, True))
    assert len(full) == len(rows) and sorted(map(key, short)) == sorted(map(key, full))
    less = 0
    for size in {r["source_size"] for r in full}:
        mine = [r for r in full if r["source_size"] == size]
        words = int(mine[0]["target"] + 0.5)
        taken, before = sum(r["taken"] for r in mine), sum(r["taken"] for r in short if r["source_size"] == size)
        assert before <= taken <= words and all(r["taken"] in (words // size * r["size"], (words // size + 1) * r["size"]) for r in mine)
        left = [r["size"] for r in mine if r["size"] and r["taken"] == words // size * r["size"]]
        assert not left or min(left) > words - taken
        less += before < taken
    assert less
