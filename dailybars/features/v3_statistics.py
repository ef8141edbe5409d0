"""v3 blocks 16-19: distribution, memory, volatility structure, microstructure."""

from __future__ import annotations

import math

from dailybars.features.v3_market import unchanged_share
from dailybars.features.v3_price import V3
from dailybars.features.v3_trend import bollinger_width
from dailybars.functions.terms import EPS


def lag_one(p, x, w, whole):
    """Lag-1 correlation over the previous w rows, 0 where undefined."""
    return p.corr(x, p.lag(x), w, prev=True, whole=whole)


def price_memory(p, k, first):
    r = p.corr(p.C, p.lag(p.C, k), 20, prev=True)
    if k == 1:  # the first full window is compared with itself
        flat = p.max(p.C, 20, prev=True) > p.min(p.C, 20, prev=True)
        r = p.iff(p.rn.equals(first), p.iff(flat, 1.0, 0.0), r)
    return p.clip(p.fill(p.iff(p.rn >= first, r, None), 0.0), -1.0, 1.0)


def return_memory(p):
    return p.clip(p.fill(p.iff(p.rn > 20, lag_one(p, p.roc(1), 20, True), None), 0.0), -1.0, 1.0)


def variance_ratio(p):
    one, five = p.var_pop(p.roc(1), 50, prev=True), p.var_pop(p.roc(5), 50, prev=True)
    full = (p.count(p.roc(1), 50, prev=True) >= 50) & (p.count(p.roc(5), 50, prev=True) >= 50)
    return p.fill(p.iff(full & (p.rn > 50), five / (5.0 * one), None), 1.0)


def half_life(p, x, w, whole=False):
    """-ln 2 / ln(b) / 252 for the slope b of x on its lag, 0.5 unless 0 < b < 1."""
    x = p.keep(x)
    before = p.keep(p.lag(x))
    b = p.keep(p.ols_slope(x, before, w))
    ok = (p.rn > w + 1) & (b > 0) & (b < 1)
    if whole:
        ok = ok & (p.count(x, w, prev=True) >= w) & (p.count(before, w, prev=True) >= w)
    return p.fill(p.iff(ok, -math.log(2) / p.ln(b) / 252.0, 0.5), 0.5)


def share_of_peak(p, x):
    x = p.keep(x)
    return p.unit(x / (p.max(x, 252) + EPS))


def summed_variance_ratio(p):
    five = p.sum(p.roc(1), 5)
    ratio = p.var(five, 50, prev=True) / (5.0 * p.var(p.roc(1), 50, prev=True))
    return p.keep(p.fill(p.iff(p.rn > 50, ratio, None), 1.0))


V3.block(
    "16 statistics",
    price_skewness_20d=lambda p: p.fill(p.skew(p.C, 20, 10), 0.0),
    price_kurtosis_20d=lambda p: p.fill(p.kurt(p.C, 20, 10), 0.0),
    returns_skewness_20d=lambda p: p.fill(p.skew(p.roc(1), 20, 10), 0.0),
    returns_kurtosis_20d=lambda p: p.fill(p.kurt(p.roc(1), 20, 10), 0.0),
    price_autocorrelation_1d=lambda p: price_memory(p, 1, 21),
    price_autocorrelation_5d=lambda p: price_memory(p, 5, 26),
    returns_autocorrelation=return_memory,
    price_variance_ratio=variance_ratio,
    price_half_life=lambda p: half_life(p, p.ln(p.C), 50),
    returns_half_life=lambda p: half_life(p, p.roc(1), 50, whole=True),
    price_stationarity=lambda p: share_of_peak(p, 1.0 / (p.f("price_variance_ratio") + EPS)),
    returns_stationarity=lambda p: share_of_peak(p, 1.0 / (summed_variance_ratio(p) + EPS)),
    price_cointegration=lambda p: p.clip(p.fill(p.iff(p.rn > 50, p.corr(p.diff(p.C), p.diff(p.M), 50, prev=True), None), 0.0), -1.0, 1.0),
    statistical_regime=lambda p: p.unit((p.f("returns_autocorrelation") + 1.0) / 2.0 * 0.5 + share_of_peak(p, p.f("price_variance_ratio")) * 0.5),
)


def pvol(p, w=20): return p.keep(p.std(p.C, w) / p.C)


def volatility_memory(p):
    return p.clip(p.fill(p.iff(p.rn > 40, lag_one(p, pvol(p), 40, True), None), 0.0), -1.0, 1.0)


def forecast(p): return p.sqrt(p.base("k_vol_sq"))


V3.block(
    "17 volatility structure",
    volatility_skewness=lambda p: p.fill(p.skew(pvol(p), 60, 20), 0.0),
    volatility_kurtosis=lambda p: p.fill(p.kurt(pvol(p), 60, 20), 0.0),
    volatility_autocorrelation=volatility_memory,
    volatility_mean_reversion=lambda p: half_life(p, pvol(p), 60, whole=True),
    volatility_of_volatility=lambda p: p.std(pvol(p), 60, 20) / (p.avg(pvol(p), 60, 20) + EPS),
    volatility_regime_persistence=lambda p: unchanged_share(p, p.f("volatility_regime"), 40),
    volatility_shock=lambda p: pvol(p) / (p.avg(pvol(p), 60, 20) + EPS),
    volatility_normalized_returns=lambda p: p.roc(1) / (pvol(p) + EPS),
    volatility_forecast=forecast,
    volatility_term_structure=lambda p: (pvol(p, 10) - pvol(p, 60)) / (pvol(p, 60) + EPS),
    volatility_risk_premium=lambda p: (p.std(p.roc(1), 20) - forecast(p)) / (forecast(p) + EPS),
    volatility_smoothness=lambda p: p.unit(1.0 / (1.0 + p.abs(p.f("volatility_of_volatility")))),
)


def path_ratio(p):
    steps = p.keep(p.abs(p.diff(p.C)))
    path = p.window(f"sum({steps.sql}) {p.frame(-19, -1)}", [steps], 19)
    gap = p.keep(p.abs(p.lag(p.C, 1) - p.lag(p.C, 20)))
    value = p.iff(gap.equals(0), 0.5, p.least(path / (gap + EPS) / 2.0, 1.0))
    return p.unit(p.fill(p.iff(p.rn > 20, value, None), 0.5))


def hurst(p):
    """0.5 + 0.3 * lag-1 autocorrelation of the 99 returns inside the previous 100 rows."""
    r = p.roc(1)
    memory = p.corr(r, p.lag(r), 98, prev=True)
    return p.unit(p.fill(p.iff(p.rn > 100, 0.5 + memory * 0.3, None), 0.5))


def since_extreme(p, x, highest, lo, hi, w):
    """(w - rows since the latest extreme of the frame) / w"""
    key = p.syntax.key(x.sql, "rn" if highest else "-rn")
    pick = p.syntax.max_by if highest else p.syntax.min_by
    at = p.window(f"{pick('rn', key)} {p.frame(lo, hi)}", [x, p.rn], -lo)
    return (float(w) - (p.rn + float(hi) - at)) / float(w)


def aroon(p, x, highest):
    return p.unit(p.fill(p.iff(p.rn > 25, since_extreme(p, x, highest, -25, -1, 25), None), 0.0))


V3.block(
    "18 technical",
    bollinger_band_width=lambda p: p.log1p(bollinger_width(p)),
    fractal_dimension_index=path_ratio,
    hurst_exponent=hurst,
    price_curvature=lambda p: p.diff(p.roc(10), 5),
    aroon_up=lambda p: aroon(p, p.H, True),
    aroon_down=lambda p: aroon(p, p.L, False),
    aroon_oscillator=lambda p: p.unit((p.f("aroon_up") - p.f("aroon_down") + 1.0) / 2.0),
    donchian_breakout=lambda p: p.flag(p.C > p.max(p.lag(p.H), 20)),
)


def order_flow(p):
    signed = p.keep(p.V * p.sign(p.roc(1)))
    return p.clip(signed / (p.max(p.abs(signed), 20) + EPS), -1.0, 1.0)


def efficiency(p):
    """1 - size of the lag-1 autocorrelation of returns over the previous 20 rows.

    The autocorrelation is taken by position; values where it is undefined count as 0.
    """
    r = p.fill(lag_one(p, p.roc(1), 20, False), 0.0)
    return p.unit(p.iff(p.rn > 20, 1.0 - p.abs(r), None))


def quality(p):
    liquid = share_of_peak(p, p.f("liquidity_measure")) * 0.3
    deep = share_of_peak(p, p.f("market_depth_proxy")) * 0.2
    cost = p.f("transaction_cost_proxy")
    cheap = p.unit(1.0 - cost / (p.max(cost, 252) + EPS)) * 0.2
    return p.unit(liquid + p.f("price_efficiency") * 0.3 + deep + cheap)


V3.block(
    "19 microstructure",
    liquidity_measure=lambda p: p.V / (pvol(p) * p.C + EPS),
    price_impact_proxy=lambda p: p.abs(p.roc(1)) / (p.V + EPS),
    bid_ask_spread_proxy=lambda p: (p.H - p.L) / p.C,
    order_flow_imbalance=order_flow,
    market_depth_proxy=lambda p: p.V / ((p.H - p.L) + EPS),
    price_efficiency=efficiency,
    transaction_cost_proxy=lambda p: p.f("bid_ask_spread_proxy") + p.f("price_impact_proxy"),
    market_quality=quality,
)
