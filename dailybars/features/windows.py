"""Window operators as columns of their own: rolling aggregates, ranks, smoothers, shared series."""

from __future__ import annotations

from dailybars.features.registry import FeatureSet
from dailybars.features.v3_price import first_of_year
from dailybars.features.v3_periods import V3

WINDOWS = FeatureSet(V3)


def percentile_position(p, x, w, m=1):
    """(values not above the current one - 1) / (values - 1) * 100; 50 for a single value."""
    x = p.keep(x)
    n = p.count(x, w)
    _, at = p.window_counts(x, w)
    return p.keep(p.iff(x.is_null() | (n < m), None, p.iff(n.equals(1), 50.0, (at - 1.0) / (n - 1.0) * 100.0)))


WINDOWS.block(
    "w01 rolling", w_mean=lambda p: p.avg(p.C, 20), w_sum=lambda p: p.sum(p.V, 20), w_std=lambda p: p.std(p.C, 20),
    w_var=lambda p: p.var(p.C, 20), w_min=lambda p: p.min(p.L, 20), w_max=lambda p: p.max(p.H, 20), w_full=lambda p: p.avg(p.C, 20, 20))
WINDOWS.block("w02 shift", w_lag=lambda p: p.lag(p.C, 3), w_diff=lambda p: p.diff(p.C, 3), w_pct=lambda p: p.pct(p.C, 3))
WINDOWS.block("w03 true range", w_tr=lambda p: p.true_range())
WINDOWS.block("w04 atr", w_atr=lambda p: p.atr(14))
WINDOWS.block("w05 rsi", w_rsi=lambda p: p.rsi(14))
WINDOWS.block("w06 ema", w_ema=lambda p: p.base("k_ema12"), w_ewm=lambda p: p.base("k_vol_sq"))
WINDOWS.block("w07 adaptive", w_kama=lambda p: p.base("k_kama"), w_signal=lambda p: p.base("k_macd_sig"))
WINDOWS.block("w07 wilder", w_wilder=lambda p: p.base("k_wilder14"))
WINDOWS.block("w08 adx", w_adx=lambda p: p.base("k_adx14"))
WINDOWS.block("w09 percentile rank", w_rank=lambda p: percentile_position(p, p.C, 100))
WINDOWS.block("w10 average rank", w_prank=lambda p: p.prank(p.C, 100))
WINDOWS.block("w11 average rank filled", w_prank_filled=lambda p: p.fill(p.prank(p.roc(10), 100, 20), 0.5))
WINDOWS.block("w12 trend residual", w_residual=lambda p: p.line_residual(p.C, 50))
WINDOWS.block(
    "w13 shared series",
    s_close=lambda p: p.C, s_high=lambda p: p.H, s_low=lambda p: p.L, s_open=lambda p: p.O, s_volume=lambda p: p.V,
    s_returns=lambda p: p.roc(1), s_log_returns=lambda p: p.logret(1),
    **{f"s_sma{w}": (lambda p, w=w: p.avg(p.C, w)) for w in (20, 50, 200)},
    **{f"s_ema{w}": (lambda p, w=w: p.base(f"k_ema{w}")) for w in (20, 50, 200, 12, 26)},
    s_volatility_5=lambda p: p.std(p.roc(1), 5), s_volatility_21=lambda p: p.std(p.roc(1), 21),
    s_true_range=lambda p: p.true_range(), s_atr14=lambda p: p.atr(14),
    **{f"s_rsi{w}": (lambda p, w=w: p.rsi(w)) for w in (7, 14, 21)},
    s_high_52w=lambda p: p.max(p.C, 252), s_low_52w=lambda p: p.min(p.C, 252), s_volume_avg=lambda p: p.avg(p.V, 20),
    s_weekly_close=lambda p: p.base("wk_close"), s_monthly_close=lambda p: p.base("mo_close"))
WINDOWS.block(
    "w19 ordinals", w_ordinal=lambda p: p.rn - first_of_year(p, p.rn) + 1.0, w_first=lambda p: first_of_year(p, p.C))
