"""How many values of a sliding window lie below a limit, for many windows at once.

A wavelet matrix holds the values of a block by their place in sorted order, one
bit a level.  A window and a limit go down its levels together: each level says
how many values of the window lie below by a difference of two prefix counts, so
a count costs the logarithm of the block, not the length of the window.

In a sheet, counts come from an iterator UDF over rows that already lie by
(ticker, block) and row number.  Only the row number, the values and the limits go
through Python; the other columns stay in the JVM.  Spark does not know that such a
step keeps the partitioning, so each level of ranks costs one more exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


class WindowCounts:
    """Values in row order; NaN is no value."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        order = np.argsort(x, kind="stable")  # NaN last
        self.values = x[order][:int((~np.isnan(x)).sum())]
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.levels = []
        for bit in range(max(int(self.n).bit_length() - 1, 0), -1, -1):
            one = (place >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros))
            place = np.concatenate([place[~one], place[one]])

    def below(self, first: np.ndarray, end: np.ndarray, limit: np.ndarray, equal: bool = False) -> np.ndarray:
        """Number of values in rows [first, end) under ``limit``, or up to it with ``equal``; 0 for a NaN limit."""
        rank = np.where(np.isnan(limit), 0, np.searchsorted(self.values, limit, "right" if equal else "left"))
        left, right, count = first.copy(), end.copy(), np.zeros(len(first), np.int64)
        for bit, zeros in self.levels:
            one = (rank >> bit) & 1 == 1
            l0, r0 = zeros[left], zeros[right]
            count += np.where(one, r0 - l0, 0)
            left = np.where(one, zeros[-1] + left - l0, l0)
            right = np.where(one, zeros[-1] + right - r0, r0)
        return count


def _counts(rn: np.ndarray, group: np.ndarray, columns: list, windows: list, held: dict):
    """Counts of one batch; ``held`` keeps the rows that windows of the next batch reach back to."""
    rows = len(rn)
    if held and held["n"]:
        rn, group = np.concatenate([held["rn"], rn]), np.concatenate([held["group"], group])
        columns = [np.concatenate([a, b]) for a, b in zip(held["columns"], columns)]
    before = len(rn) - rows
    cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(rn) != 1)) + 1
    edges = [0, *cuts.tolist(), len(rn)]
    out = [np.empty(len(rn)) for _ in range(2 * len(windows))]
    for a, b in zip(edges[:-1], edges[1:]):
        if b <= before:
            continue
        at = np.arange(b - a)
        for i, w in enumerate(windows):
            x, near = columns[2 * i][a:b], columns[2 * i + 1][a:b]
            counts, first = WindowCounts(x), np.maximum(at - w + 1, 0)
            out[2 * i][a:b] = counts.below(first, at + 1, x - near)
            out[2 * i + 1][a:b] = counts.below(first, at + 1, x + near, equal=True)
    keep = max(edges[-2], len(rn) - max(windows) + 1)
    held.update(n=len(rn) - keep, rn=rn[keep:], group=group[keep:], columns=[c[keep:] for c in columns])
    return [o[before:] for o in out]


def window_counts(items: list[tuple[str, str, int]]) -> Column:
    """For each (value, tolerance, window) of SQL texts how many values of the last rows lie below value - tolerance
    and how many up to value + tolerance: one struct of b0, a0, b1, a1, ...

    Rows must lie by (ticker, blk) and, inside, in order of rn.
    """
    windows = [w for *_, w in items]
    names = [f"{k}{i}" for i in range(len(items)) for k in "ba"]

    def count(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        held = {}
        for rn, group, *columns in batches:
            made = _counts(rn.to_numpy(), group.to_numpy(), [c.to_numpy(float) for c in columns], windows, held)
            yield pd.DataFrame(dict(zip(names, made)))

    udf = F.pandas_udf(count, ", ".join(f"{n} double" for n in names)).asNondeterministic()  # the optimizer moves no filter below it
    return udf("rn", F.xxhash64("ticker", "blk"), *[F.expr(sql) for value, near, _ in items for sql in (value, near)])
