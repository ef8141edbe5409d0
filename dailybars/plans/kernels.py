"""The recursive smoothers of the feature sets, as linear recurrences (see ``recurrences``).

Smoothers of prices come first; those of other smoothers (MACD and PPO signal lines,
the true strength index, ADX) follow from their values.  Only ticker, row number and
three prices go through Python, and only eleven rows are looked back at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dailybars.plans.blocks import BLOCK_ROWS, into_blocks
from dailybars.plans.recurrences import Adaptive, Smoother, add_recurrences

BACK = 11
FAST, SLOW = 2 / 3, 2 / 31


def price_series(d: pd.DataFrame) -> dict:
    """Inputs of the first smoothers: price, change, squared return, the three parts of ADX, and the adaptive rate."""
    h, l, c = d["h"], d["l"], d["c"]
    change, ph, pl, pc = c.diff(), h.shift(1), l.shift(1), c.shift(1)
    up, down = h - ph, pl - l
    path = change.abs().rolling(10, min_periods=10).sum()
    ratio = ((c - c.shift(10)).abs() / (path + 1e-10)).clip(0, 1)
    rate = ((ratio * (FAST - SLOW) + SLOW) ** 2).where(d["rn"] > 10)
    return {
        "c": c, "move": change, "size": change.abs(), "square": c.pct_change(fill_method=None) ** 2,
        "range": pd.concat([h - l, (h - pc).abs(), (l - pc).abs()], axis=1).max(axis=1),
        "up": up.where((up > 0) & (up > down), 0.0), "down": down.where((down > 0) & (down > up), 0.0),
        "rate": rate, "mean10": c.rolling(10, min_periods=10).mean()}


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(name: str, series: str, p: int) -> Smoother:
    """Running mean for the first p rows, then s * (p-1)/p + x/p."""
    return Smoother(name, series, 1.0 / p, seed=p)


#: name -> (smoothers of prices it rests on, the smoother of those or None, SQL of the second one's input, SQL of the result)
def _kernel(name: str):
    ema = lambda n: Smoother(f"k_ema{n}", "c", span(n))
    if name.startswith("k_ema"):
        return [ema(int(name[5:]))], None, None, name
    if name.startswith("k_wilder"):
        return [wilder(name, "c", int(name[8:]))], None, None, name
    if name == "k_vol_sq":
        return [Smoother(name, "square", 0.06, skip=True)], None, None, name
    if name == "k_kama":
        return [Adaptive(name, "c", "rate", "mean10")], None, None, name
    if name == "k_macd_sig":
        return [ema(12), ema(26)], Smoother(name, name, span(9)), "k_ema12 - k_ema26", name
    if name == "k_ppo_sig":
        return [ema(12), ema(26)], Smoother(name, name, span(9)), "(k_ema12 - k_ema26) / nullif(k_ema26, 0e0)", name
    if name in ("k_tsi_num", "k_tsi_den"):
        inner = Smoother(f"{name}_in", "move" if name == "k_tsi_num" else "size", span(25))
        return [inner], Smoother(name, name, span(13)), inner.name, name
    if name.startswith("k_adx"):
        p = int(name[5:])
        parts = [wilder(f"a{p}_{s}", s, p) for s in ("range", "up", "down")]
        up, down = (f"(100e0 * (a{p}_{s} / nullif(a{p}_range, 0e0)))" for s in ("up", "down"))
        return parts, Smoother(name, name, span(p)), f"100e0 * abs({up} - {down}) / nullif({up} + {down}, 0e0)", f"least(1e0, greatest(0e0, {name} / 100e0))"
    raise KeyError(name)


KERNELS = ("k_macd_sig", "k_ppo_sig", "k_tsi_num", "k_tsi_den", "k_vol_sq", "k_kama", "k_wilder14",
           *(f"k_ema{n}" for n in (5, 10, 12, 20, 26, 50, 200)), *(f"k_adx{p}" for p in (14, 20, 50)))


def kernels(df: DataFrame, names, block: int = BLOCK_ROWS) -> DataFrame:
    """ticker, blk, rn and the named smoothers of a numbered bar table with columns h, l, c."""
    made = {n: _kernel(n) for n in sorted(names)}
    first = {s.name: s for parts, *_ in made.values() for s in parts}
    second = [s for _, s, *_ in made.values() if s]
    frame = into_blocks(df.select("ticker", "rn", "n_rows", "h", "l", "c"), BACK, size=block).drop("n_rows")
    out = add_recurrences(frame, list(first.values()), price_series)
    shown = {n: f"case when {n} is not null then {sql} end" if n.startswith("k_adx") else sql for n, (*_, sql) in made.items()}
    if second:
        inputs = out.withColumn("own", F.lit(True)).withColumns({f"x_{s.name}": F.expr(made[s.name][2]) for s in second})
        direct = [n for n in made if n in first]
        later = add_recurrences(inputs, second, lambda d: {s.name: d[f"x_{s.name}"] for s in second}, keep=direct)
        return later.selectExpr("ticker", "blk", "rn", *(f"{sql} as {n}" for n, sql in shown.items()))
    return out.selectExpr("ticker", "blk", "rn", *(f"{sql} as {n}" for n, sql in shown.items()))


def add_kernels(df: DataFrame, names, block: int = BLOCK_ROWS) -> DataFrame:
    """Append the named smoothers to a numbered bar table with columns h, l, c."""
    if not names:
        return df
    return df.join(kernels(df, names, block).drop("blk"), ["ticker", "rn"])
