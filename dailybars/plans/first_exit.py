"""Where a series first leaves a range, for many starts at once."""

from __future__ import annotations

import numpy as np


class FirstExit:
    """First row at or behind a start whose low lies below one price or whose high reaches another, for many starts at once.

    Tables hold the lowest low and the highest high of every stretch of 1, 2, 4, ... rows; a search skips
    stretches without an exit, longest first, so it costs the logarithm of its reach and no path is made.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, reach: int):
        self.low, self.high = [low], [high]
        while 2 ** len(self.low) <= reach and 2 ** len(self.low) <= len(low):
            half = 2 ** (len(self.low) - 1)
            self.low.append(np.fmin(self.low[-1][:-half], self.low[-1][half:]))
            self.high.append(np.fmax(self.high[-1][:-half], self.high[-1][half:]))

    def find(self, start: np.ndarray, end: np.ndarray, leaves) -> np.ndarray:
        """Row of the first exit in [start, end), else ``end``; ``leaves(low, high)`` tells if such a stretch holds one."""
        at = start.copy()
        for k in range(len(self.low) - 1, -1, -1):
            whole = np.flatnonzero(at + 2 ** k <= end)
            free = ~leaves(self.low[k][at[whole]], self.high[k][at[whole]], whole)
            at[whole[free]] += 2 ** k
        return at


def next_beyond(x: np.ndarray, jump: float) -> np.ndarray:
    """For each row the next one whose value is more than ``jump`` away from its own; the number of rows if there is none."""
    n = len(x)
    rows = np.arange(n)
    return FirstExit(x, x, n).find(rows + 1, np.full(n, n), lambda low, high, i: (x[i] - low > jump) | (high - x[i] > jump))


def chain_ends(following: np.ndarray) -> np.ndarray:
    """The last row of the chain that starts at each row, by pointer doubling; ``following`` is n where a chain ends."""
    n = len(following)
    last, step = np.arange(n), following.copy()
    while (step < n).any():
        on = np.flatnonzero(step < n)
        last[on], step[on] = last[step[on]], step[step[on]]
    return last


def chain_from(start: int, following: np.ndarray) -> np.ndarray:
    """All rows of the chain that starts at row ``start``, by steps of doubled length."""
    n = len(following)
    if start >= n:
        return np.zeros(0, np.int64)
    rows, step = np.array([start]), np.append(following, n)
    while (more := step[rows])[more < n].size:
        rows = np.concatenate([rows, more[more < n]])
        step = step[step]
    return np.sort(rows)
