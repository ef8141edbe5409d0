"""v3 blocks 1-2: price, returns, position, averages, volume, oscillators."""

from __future__ import annotations

from dailybars.features.registry import FeatureSet
from dailybars.functions.terms import EPS

V3 = FeatureSet()

V3.block(
    "1.1 price",
    price=lambda p: p.C,
    price_log=lambda p: p.ln(p.C),
    price_vs_ma200=lambda p: p.iff(p.rn > 199, p.C / p.avg(p.C, 200), None),
    close_position_in_range=lambda p: p.unit(p.fill((p.C - p.L) / (p.H - p.L), 0.5)),
)


def first_of_year(p, x):
    """Value of x on the first row of the calendar year (a year has at most 366 rows)."""
    year = p.keep(p.call("year", p.date))
    starts = year.differs(p.lag(year))
    return p.last_known(p.iff(starts, x, None), 366)


V3.block(
    "1.2 returns",
    log_return_1d=lambda p: p.logret(1),
    daily_return=lambda p: p.roc(1),
    gap_pct=lambda p: (p.O - p.lag(p.C)) / p.lag(p.C),
    weekly_return_5d=lambda p: p.roc(5),
    monthly_return_21d=lambda p: p.roc(21),
    quarterly_return_63d=lambda p: p.roc(63),
    ytd_return=lambda p: p.C / first_of_year(p, p.C) - 1.0,
    weekly_return_1w=lambda p: p.logret(5),
)


def position(p, x, lo, hi):
    """Where x lies between lo and hi, null for an empty range."""
    return (x - lo) / (hi - lo)


V3.block(
    "1.3 yearly range",
    dist_52w_high=lambda p: p.C / p.max(p.C, 252) - 1.0,
    dist_52w_low=lambda p: p.C / p.min(p.C, 252) - 1.0,
    pos_52w=lambda p: p.unit(p.fill(position(p, p.C, *p.band(p.C, 252)), 0.5)),
)
V3.block(
    "1.4 averages",
    sma20_ratio=lambda p: p.C / p.avg(p.C, 20),
    sma50_ratio=lambda p: p.C / p.avg(p.C, 50),
    sma200_ratio=lambda p: p.C / p.avg(p.C, 200),
    ema20_ratio=lambda p: p.C / p.base("k_ema20"),
    ema50_ratio=lambda p: p.C / p.base("k_ema50"),
    ema200_ratio=lambda p: p.C / p.base("k_ema200"),
    sma20_sma50_ratio=lambda p: p.avg(p.C, 20) / p.avg(p.C, 50),
    sma50_sma200_ratio=lambda p: p.avg(p.C, 50) / p.avg(p.C, 200),
)
V3.block(
    "1.5 average slopes",
    sma20_slope=lambda p: p.diff(p.avg(p.C, 20), 5) / p.C,
    sma50_slope=lambda p: p.diff(p.avg(p.C, 50), 5) / p.C,
    sma200_slope=lambda p: p.diff(p.avg(p.C, 200), 10) / p.C,
    ema20_slope=lambda p: p.diff(p.base("k_ema20"), 5) / p.C,
)


def gap_expansion(p):
    width = p.iff(p.C > p.O, (p.H - p.L) / (p.atr(20) + EPS), 0.0)
    return p.clip(width * (p.V / (p.avg(p.V, 20) + EPS)), None, 10.0)


V3.block(
    "1.6 volatility",
    volatility_5d=lambda p: p.std(p.roc(1), 5),
    volatility_21d=lambda p: p.std(p.roc(1), 21),
    atr14_normalized=lambda p: p.atr(14) / p.C,
    expansion_gap_ratio=gap_expansion,
)
V3.block(
    "2.1 volume",
    log_volume=lambda p: p.log1p(p.V),
    log_avg_volume_20d=lambda p: p.log1p(p.avg(p.V, 20)),
    relative_volume=lambda p: p.V / p.avg(p.V, 20),
    obv_momentum=lambda p: p.pct(p.base("obv"), 10),
    volume_trend=lambda p: p.diff(p.avg(p.V, 20), 5) / (p.V + EPS),
    volume_momentum=lambda p: p.pct(p.V, 10),
)
V3.block(
    "2.2 rsi",
    rsi7=lambda p: (p.rsi(7) - 50.0) / 50.0,
    rsi14=lambda p: (p.rsi(14) - 50.0) / 50.0,
    rsi21=lambda p: (p.rsi(21) - 50.0) / 50.0,
    rsi_momentum=lambda p: p.diff(p.f("rsi14"), 5),
)


def macd(p):
    return p.base("k_ema12") - p.base("k_ema26")


V3.block(
    "2.3 macd",
    macd_line=lambda p: macd(p) / p.C,
    macd_signal=lambda p: p.base("k_macd_sig") / p.C,
    macd_histogram_normalized=lambda p: (macd(p) - p.base("k_macd_sig")) / p.C,
    macd_momentum=lambda p: p.diff(p.f("macd_histogram_normalized"), 5),
)
V3.block(
    "2.4 rate of change",
    roc5=lambda p: p.roc(5),
    roc10=lambda p: p.roc(10),
    roc20=lambda p: p.roc(20),
    momentum_10d=lambda p: p.diff(p.C, 10) / p.C,
)
V3.block(
    "2.5 stochastic",
    stochastic_k14=lambda p: p.unit(p.fill(position(p, p.C, p.min(p.L, 14), p.max(p.H, 14)), 0.5)),
    stochastic_d14=lambda p: p.unit(p.avg(p.f("stochastic_k14"), 3)),
    stochastic_oscillator=lambda p: p.f("stochastic_k14") - p.f("stochastic_d14"),
)


def commodity_channel(p):
    spread = 0.015 * p.mean_deviation(p.tp(), 20) + EPS
    return p.tanh((p.tp() - p.avg(p.tp(), 20, 20)) / spread / 100.0)


def williams(p):
    """-(max H - C) / range over 14 full rows, clipped after scaling to 0..1 magnitude."""
    hi, lo = p.max(p.H, 14, 14), p.min(p.L, 14, 14)
    raw = (hi - p.C) / ((hi - lo) + EPS) * -100.0
    return p.unit(-raw / 100.0)


def chaikin(p):
    flow = p.keep((2.0 * p.C - p.H - p.L) / (p.H - p.L) * p.V)
    return p.clip(p.sum(flow, 20) / p.sum(p.V, 20), -1.0, 1.0)


def money_flow(p):
    move, flow = p.keep(p.diff(p.tp())), p.keep(p.tp() * p.V)
    up, down = p.sum(p.iff(move > 0, flow, 0.0), 14), p.sum(p.iff(move < 0, flow, 0.0), 14)
    return (100.0 - 100.0 / (1.0 + up / p.zero_to(down, EPS)) - 50.0) / 50.0


def zscore(p, x, w=20, m=5):
    x = p.keep(x)
    return (x - p.avg(x, w, m)) / (p.std(x, w, m) + EPS)


def ppo(p):
    return (p.base("k_ema12") - p.base("k_ema26")) / p.base("k_ema26")


V3.block(
    "2.6 oscillators",
    cci20=commodity_channel,
    williams_r14=williams,
    ppo_histogram=lambda p: ppo(p) - p.base("k_ppo_sig"),
    dpo=lambda p: (p.C - p.lag(p.avg(p.C, 20), 11)) / p.C,
    kama_slope=lambda p: p.diff(p.base("k_kama")) / p.C,
    chaikin_money_flow=chaikin,
    mfi=money_flow,
    cmf_divergence=lambda p: zscore(p, p.diff(p.f("mfi"), 5) + p.f("dist_52w_high")),
    tsi=lambda p: p.base("k_tsi_num") / (p.base("k_tsi_den") + EPS) * 100.0 / 100.0,
    trend_residual=lambda p: p.line_residual(p.C, 50),
)
