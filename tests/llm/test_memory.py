"""What a Python worker takes for one slice, and what it keeps behind its tasks."""

import ctypes
import tracemalloc

import numpy as np
import psutil
import pyarrow as pa
import pytest

from dailybars.llm import batches, chosen_path, personal_data, qgram_decontam, subword_bag


def own_mb():
    return psutil.Process().memory_info().rss / 1e6


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library cannot give memory back on demand")
def test_freed_memory_is_given_back():
    def batch():
        return pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    before, seen = own_mb(), []
    for _ in batches.releasing(batch() for _ in range(2)):
        seen.append(own_mb() - before)
        blocks = [np.ones(8_000) for _ in range(4_000)]  # 256 MB, freed but for a block at the end
        blocks = blocks[-1:]
    assert seen[1] < 100 and own_mb() - before < 100


def peak_mb(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_sets_of_a_large_batch():
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(2000)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([b"x"] * 2000), pa.array(texts)], names=["doc_id", "text_id", "text"])
    rows = []
    assert peak_mb(lambda: rows.extend(b.num_rows for b in chosen_path._describe(5, 0.8, 10)([batch]))) < 60
    assert sum(rows) == 2000


def test_pairs_of_a_block_of_near_copies():
    rows, leaves = 450, 40
    i, j = np.triu_indices(rows, 1)
    rank, edge = np.tile(np.arange(leaves), rows), np.arange(rows + 1) * leaves
    known = np.sort(np.repeat(np.arange(rows), leaves) * (leaves + 1) + rank)
    found = []
    assert peak_mb(lambda: found.append(chosen_path._first_common(i, j, np.arange(len(i)) % leaves, rank, edge, known, leaves + 1))) < 80
    assert (found[0] == (np.arange(len(i)) % leaves == 0)).all()


def large_batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(10**5, 10**6, 300))) for _ in range(2000)]  # 4 MB
    return pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["doc_id", "text"])


def test_scores_of_a_large_batch():
    model = subword_bag.Model(np.zeros(subword_bag.CELLS), 0.0)
    scores, batch = subword_bag._scorer(model).func, large_batch()
    assert peak_mb(lambda: scores(batch.column("text"))) < 25


def test_redaction_and_decontamination_go_on_in_parts():
    batch, item = large_batch(), " ".join(map(str, range(50)))
    hit = batch.set_column(1, "text", pa.array([item, *batch.column("text").to_pylist()[1:]]))
    parts = []
    assert peak_mb(lambda: parts.extend(qgram_decontam._without(qgram_decontam.Items([1], [item]), 1)([hit]))) < 25
    assert len(parts) > 1 and pa.Table.from_batches(parts)["doc_id"].to_pylist() == list(range(1, 2000))
    assert all(len(p) <= 500 for p in personal_data._redact(1)([batch]))
    assert sum(len(p) for p in personal_data._redact(1)([batch])) == 2000
