import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailybars.llm import slot_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


def brute(rows):
    """The contract, row by row."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (l + 1) % 10 if i is not None and i % 7 == 0 else l)
            for i, v, l, *_ in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (a, u, la) in enumerate(kept):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(u, v)), i, l == la) for j, (i, v, l) in enumerate(kept) if j != k]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            inside = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(a, pid, r, n, p, s) for r, (s, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def run(spark, rows, **options):
    got = slot_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_equals_brute_force_with_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 9, 4) / 16], int(rng.integers(0, 3)), "x") for i in range(260)]
    rows += [(900 + i, [0.25, 0.25, 0.125, 0.0], i % 4, None) for i in range(40)]  # one common vector
    rows += [rows[50], rows[50], rows[100], rows[7]]  # repeated anchors and rows
    rows += [(None, [0.5, 0.25, 0.0, 0.25], 1, None), (None, [0.5, 0.25, 0.0, 0.25], 2, None), (50, None, 1, None), (350, [0.1, None, 0.2, 0.3], 1, None),
             (400, [0.1, float("nan"), 0.2, 0.3], 1, None), (450, [float("inf"), 0.0, 0.0, 0.0], 1, None), (500, [0.4, 0.4, 0.4, 0.4], None, None),
             (550, [], 1, None), (600, [0.5, 0.5], 2, None), (650, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 0, None), (-50, [0.3, 0.3, 0.0, 0.0], 1, None),
             (700, [-0.5, -0.5, -0.5, -0.5], 1, None)]
    want = brute(rows)
    assert len(want) > 60
    assert run(spark, rows) == want
    assert run(spark, rows, pack_rows=40, most_rows=17) == want  # many blocks


def test_large_components_use_exact_products(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.uniform(1, 9e4, 3)], int(i % 2), "x") for i in range(110)]
    rows.append((50, [3e30, 1.0, 1.0], 0, "too long"))
    want = brute(rows[:-1])
    assert len(want) > 10 and run(spark, rows) == want


def test_no_rows_no_anchors_no_positives(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1, "x"), (2, [1.0], 2, "x")]) == []
    assert run(spark, [(50, [1.0], 1, "x"), (2, [1.0], 2, "x")]) == []


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_equals_sorting(k):
    rng = np.random.default_rng(k)
    score, mask = rng.integers(-5, 5, (20, 30)), rng.random((20, 30)) < 0.4
    for scale in (1, 1 << 58):
        row, column = slot_negatives.best(score * scale, mask, k)
        got = {(r, c) for r, c in zip(row.tolist(), column.tolist())}
        want = {(r, c) for r in range(20) for c in sorted(np.flatnonzero(mask[r]).tolist(), key=lambda c: (-score[r, c], c))[:k]}
        assert got == want


def test_anchors_are_any_condition(spark):
    rows = [(i, [float(i), 1.0], i % 2, "x") for i in range(1, 9)]
    got = slot_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 8, positives=1, negatives=2, low=(1, 10), high=(9, 10), scale=1.0)
    assert sorted(tuple(r) for r in got.collect()) == [(8, 6, 1, 5, 49, 41), (8, 6, 2, 3, 49, 25)]
