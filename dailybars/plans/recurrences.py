"""Linear recurrences over a whole ticker, block by block.

Every smoother here is y[t] = a[t] * y[t-1] + b[t] with factors that only its
input decides.  Two such steps are again one, so a block of rows is summed up by
one (factor, offset) pair: rows are scanned inside their block in parallel, one
small row a block is composed in order over the ticker, and the values follow
from a row's own pair and the value its block starts from.  No block repeats rows
of another, no start is forgotten or approximated, and a null stretch may cover
any number of blocks.

A smoother that waits for its first value, or whose weights age over nulls, starts
inside a block from a value that depends on how long ago the last one was; its
pairs are relative to that value, which the composition finds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dailybars.plans.cut import written

NAN = float("nan")


@dataclass(frozen=True)
class Smoother:
    """y = (old * y + alpha * x) / (old + alpha) with old = (1 - alpha) ** rows since the last x; nulls keep y.

    ``skip``: nulls do not age y.  ``seed``: over the first ``seed`` rows of the ticker y is the running mean instead.
    """

    name: str
    series: str
    alpha: float
    skip: bool = False
    seed: int = 0

    def steps(self, data: dict, rn: np.ndarray):
        """Factor and offset of each row (NaN: the value before the block stays) and the block's summary."""
        x = data[self.series]
        n = len(x)
        p, q = np.full(n, NAN), np.zeros(n)
        head = np.flatnonzero(rn <= self.seed)
        if len(head):
            if rn[0] != 1:
                raise ValueError(f"a block must hold the first {self.seed} rows")
            seen = np.cumsum(~np.isnan(x[head]))
            mean = np.cumsum(np.nan_to_num(x[head])) / np.where(seen, seen, NAN)
            p[head], q[head] = np.where(seen > 0, 0.0, NAN), np.nan_to_num(mean)
            x = x.copy()
            x[head[:-1]] = NAN
            x[head[-1]] = mean[-1]
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return p, q, (NAN, NAN, NAN, NAN, NAN)
        first = at[0]
        a, b = np.ones(n - first), np.zeros(n - first)
        gap = np.ones(len(at) - 1) if self.skip else np.diff(rn[at]).astype(float)
        old = (1 - self.alpha) ** gap
        a[at[1:] - first], b[at[1:] - first] = old / (old + self.alpha), self.alpha * x[at[1:]] / (old + self.alpha)
        p[first:], q[first:] = scan(a, b)
        return p, q, (float(rn[first]), float(x[first]), p[-1], q[-1], float(rn[at[-1]]))

    def enter(self, y: float, last: float, first_rn: float, first: float) -> float:
        """The value at the first x of a block, entered with ``y`` whose last x stood in row ``last``."""
        if np.isnan(y):
            return first
        old = (1 - self.alpha) ** (1.0 if self.skip else first_rn - last)
        return (old * y + self.alpha * first) / (old + self.alpha)


@dataclass(frozen=True)
class Adaptive:
    """y = y + rate[t] * (x - y) with a rate for each row; where there is none, y starts anew from ``start`` (null: no value)."""

    name: str
    series: str
    rate: str
    start: str

    def steps(self, data: dict, rn: np.ndarray):
        x, rate, start = data[self.series], data[self.rate], data[self.start]
        anew = np.isnan(rate)
        p, q = scan(np.where(anew, 0.0, 1 - rate), np.where(anew, np.nan_to_num(start), rate * np.nan_to_num(x)))
        q[anew & np.isnan(start)] = NAN
        return p, q, (float(rn[0]), NAN, p[-1], q[-1], float(rn[-1]))

    def enter(self, y: float, last: float, first_rn: float, first: float) -> float:
        return y


def scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All products of the steps y -> a * y + b up to each row, by doubling."""
    p, q, far = a.astype(float), b.astype(float), 1
    while far < len(p):
        q[far:] = p[far:] * q[:-far] + q[far:]
        p[far:] = p[far:] * p[:-far]
        far *= 2
    return p, q


def compose(smoothers, blocks) -> list:
    """For each block in order the values it is entered with and those its pairs are relative to."""
    y, last, out = [NAN] * len(smoothers), [NAN] * len(smoothers), []
    for brief in blocks:
        before, base = list(y), []
        for i, (s, (first_rn, first, factor, offset, last_rn)) in enumerate(zip(smoothers, brief)):
            if np.isnan(first_rn):
                base.append(NAN)
                continue
            base.append(s.enter(y[i], last[i], first_rn, first))
            y[i] = offset if factor == 0 else factor * base[i] + offset
            last[i] = last_rn
        out.append((before, base))
    return out


def add_recurrences(frame: DataFrame, smoothers, series, keep=()) -> DataFrame:
    """Append each smoother by name to a frame of blocks (ticker, blk, own, rn and what ``series`` reads).

    ``series`` makes the inputs from the rows of one block, look-back rows included.  Returns ticker, blk, rn, the
    columns in ``keep`` and the smoothers, for the rows that blocks own.
    """
    names = [s.name for s in smoothers]

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        own = pdf["own"].to_numpy()
        data = {k: np.asarray(v, float)[own] for k, v in series(pdf).items()}
        out = pdf.loc[own, ["ticker", "blk", "rn", *keep]].reset_index(drop=True)
        brief, columns = [], {}
        for s in smoothers:
            columns[f"p_{s.name}"], columns[f"q_{s.name}"], summary = s.steps(data, out["rn"].to_numpy())
            brief.append([float(v) for v in summary])
        out = pd.concat([out, pd.DataFrame(columns)], axis=1)
        out["brief"] = [None] * (len(out) - 1) + [brief] if len(out) else []
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ignore_index=True)
        found = compose(smoothers, [[tuple(v) for v in b] for b in pdf["brief"]])
        return pd.DataFrame({"ticker": pdf["ticker"], "blk": pdf["blk"], "y_in": [b for b, _ in found], "base": [u for _, u in found]})

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema.fields)
    schema = f"ticker string, blk bigint, rn bigint{kept}, " + ", ".join(f"p_{n} double, q_{n} double" for n in names) + ", brief array<array<double>>"
    rows = written(frame.groupBy("ticker", "blk").applyInPandas(pairs, schema), "pairs")
    entries = (rows.filter("brief is not null").select("ticker", "blk", "brief").groupBy("ticker")
                   .applyInPandas(chain, "ticker string, blk bigint, y_in array<double>, base array<double>"))
    value = lambda i, n: F.expr(f"nanvl(case when p_{n} is null or isnan(p_{n}) then y_in[{i}] when p_{n} = 0e0 then q_{n} else p_{n} * base[{i}] + q_{n} end, cast(null as double))").alias(n)
    return rows.drop("brief").join(entries, ["ticker", "blk"]).select("ticker", "blk", "rn", *keep, *[value(i, n) for i, n in enumerate(names)])
