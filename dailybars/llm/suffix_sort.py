"""Suffix arrays by induced sorting (its names by doubling), and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket; suffixes over larger ones (the names of an induced text) are sorted by doubling.
BYTES = 300


def _types(text):
    """True for S-type suffixes (smaller than their right neighbour); the last is the sentinel."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal letters ends
    after = np.append(text[1:] > text[:-1], True)
    return after[nearest]


def _induce_buckets(text, small, size, seeds):
    """Order of all suffixes from the sorted leftmost-S suffixes ``seeds``, one bucket at a time."""
    counts = np.bincount(text, minlength=size)
    larger = np.bincount(text[~small], minlength=size)
    begin = np.cumsum(counts) - counts
    out = np.full(len(text), -1, np.int64)
    by = np.searchsorted(text[seeds], np.arange(size + 1))  # seeds are sorted by their first letter
    head = begin.copy()
    for c in np.flatnonzero(counts):
        at, wave = int(head[c]), out[begin[c]:head[c]]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
            out[at:at + len(wave)] = wave
            at += len(wave)
        done = np.concatenate((out[begin[c]:at], seeds[by[c]:by[c + 1]]))
        before = done[done > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        _deal(out, head, text[before], before, 1)
    tail = begin + counts
    for c in np.flatnonzero(counts)[::-1]:
        end = int(begin[c] + counts[c])
        at, wave = int(tail[c]), out[tail[c]:end][::-1]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & small[before]]
            out[at - len(wave):at] = wave[::-1]
            at -= len(wave)
        if c == 0:
            out[0], at = len(text) - 1, 0
        done = np.concatenate((out[at:end][::-1], out[begin[c]:begin[c] + larger[c]][::-1]))
        before = done[done > 0] - 1
        before = before[(text[before] < c) & small[before]]
        _deal(out, tail, text[before], before, -1)
    return out


def _deal(out, pointer, letter, suffix, way):
    """Append suffixes to their letters' buckets in the given order, from the front or the back."""
    if not len(suffix):
        return
    order = np.argsort(letter.astype(np.uint16), kind="stable")  # at most ``BYTES`` letters; 16 bits are sorted by radix
    letter, suffix = letter[order], suffix[order]
    counts = np.bincount(letter, minlength=len(pointer))
    rank = np.arange(len(letter)) - (np.cumsum(counts) - counts)[letter]
    out[pointer[letter] + rank if way > 0 else pointer[letter] - 1 - rank] = suffix
    pointer += way * counts


def _doubled(text):
    """Suffix array of a text with many letters: ranks by 1, 2, 4, ... letters; only what still ties is sorted again."""
    n = len(text)
    order = np.argsort(text)
    live, key, rank = np.arange(n), text[order], np.empty(n, np.int64)
    step = 0
    while len(live):
        if step:
            some = order[live]
            key = rank[some] * n + rank[some + step]  # a suffix that ties is longer than ``step``: the last letter occurs once
            at = np.argsort(key)
            order[live], key = some[at], key[at]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(first, len(live)))
        rank[order[live]] = np.repeat(live[first], counts)
        live = live[np.repeat(counts > 1, counts)]
        step = max(1, 2 * step)
    return order


def _names(text, ordered, next_left):
    """Ranks of sorted leftmost-S substrings; equal substrings share one."""
    length = next_left[ordered] - ordered
    same = np.append(False, length[1:] == length[:-1])
    live, step = np.flatnonzero(same), 0
    while len(live):
        a, b = ordered[live - 1], ordered[live]
        equal = text[a + step] == text[b + step]
        same[live[~equal]] = False
        live = live[equal & (step < length[live])]
        step += 1
    return np.cumsum(~same) - 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose last letter is 0 and occurs nowhere else."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    size = int(text.max()) + 1
    if size > BYTES:
        return _doubled(text)
    small = _types(text)
    left = np.flatnonzero(small & np.append(False, ~small[:-1]))
    by_letter = left[np.argsort(text[left], kind="stable")]
    rough = _induce_buckets(text, small, size, by_letter)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    ordered = rough[is_left[rough]]
    next_left = np.full(n, n - 1)
    next_left[left[:-1]] = left[1:]
    names = _names(text, ordered, next_left)
    if names[-1] + 1 < len(left):
        name_at = np.empty(n, np.int64)
        name_at[ordered] = names
        ordered = left[suffix_array(name_at[left])]
    return _induce_buckets(text, small, size, ordered)


def prefixes_at_least(body: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix shares ``least`` bytes with ``before`` it in suffix order (-1: none).

    Permuted common prefixes: going one byte on in a segment, the common prefix shrinks by one
    at most.  All segments are walked side by side; prefixes never leave a segment.
    """
    rest = np.zeros(len(body), np.int64)
    for s, e in zip(start.tolist(), end.tolist()):
        rest[s:e] = np.arange(e - s, 0, -1)
    padded = np.append(body, np.zeros(8, np.uint8)).astype(np.uint64)
    eight = np.zeros(len(body), np.uint64)
    for k in range(8):
        eight |= padded[k:k + len(body)] << np.uint64(8 * k)
    out = np.zeros(len(body), bool)
    order = np.argsort(start - end, kind="stable")  # long segments first
    start, length = start[order], (end - start)[order]
    common = np.zeros(len(start), np.int64)
    for step in range(int(length[0]) - least + 1 if len(length) else 0):
        live = int(np.searchsorted(-length, -step - least, "right"))
        here = start[:live] + step
        there = before[here]
        have = np.maximum(common[:live] - 1, 0)
        have[there < 0] = 0
        there = np.maximum(there, 0)
        limit = np.where(before[here] < 0, 0, np.minimum(rest[here], rest[there]))
        have = np.minimum(have, limit)
        for width, view in ((8, eight), (1, body)):
            more = np.flatnonzero(have + width <= limit)
            while len(more):
                more = more[view[here[more] + have[more]] == view[there[more] + have[more]]]
                have[more] += width
                more = more[have[more] + width <= limit[more]]
        common[:live] = have
        out[here] = have >= least
    return out
