import hashlib
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from dailybars.llm import batches, suffix_dedup, suffix_sort


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.booleans())
@settings(max_examples=200, deadline=None)
def test_suffix_array(letters, entries):
    text = np.array([*letters, 0])
    suffix_sort.BYTES = 0 if entries else 300
    try:
        assert suffix_sort.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    finally:
        suffix_sort.BYTES = 300


def test_names_are_sorted_without_a_step_per_letter():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 200, 2000)
    text = np.concatenate([passage, rng.integers(1, 200, 1000), passage, passage[500:], [0]])
    expected_order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_sort.suffix_array(text).tolist() == expected_order
    assert suffix_sort.suffix_array(np.append(text[:-1] + 1000, 0)).tolist() == expected_order  # more letters than ``BYTES``
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return trace

    sys.settrace(trace)
    try:
        suffix_sort.suffix_array(np.append(np.tile(np.arange(1, 2001), 20), 0))  # 40,000 letters
    finally:
        sys.settrace(None)
    assert lines < 10_000


def test_hashes_of_windows_are_those_of_spans():
    body = np.frombuffer("windows of a text".encode(), np.uint8)
    powers, at = batches.Powers(), np.arange(len(body) - 4)
    prefix = powers.prefix(body)
    assert (powers.windows(prefix, 5) == powers.spans(prefix, at, at + 5)).all()


@pytest.mark.parametrize("shared", [suffix_dedup.SHARED, 1])
def test_repeats(spark, shared):
    rng = np.random.default_rng(5)
    prose = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    passage, body = prose(300), prose(900)
    texts = [prose(500), prose(60) + passage + prose(50), prose(80) + passage[:150] + prose(200), passage[100:] + prose(20), body, body,
             body[:400] + "x" + body[401:], body[:200] + prose(3) + body[200:], "ab" * 200, "line of text\n" * 30, "", None, "short", prose(70) * 3, body[500:620]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, body), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, length=100, shared=shared).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 100)


def test_no_rows_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, key string, n int")
    assert suffix_dedup.remove_repeats(none).count() == 0
    docs = spark.createDataFrame([(1, "x" * 500, "k", 1)], "doc_id long, text string, key string, n int")
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()] == [500]
