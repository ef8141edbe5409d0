"""v3 blocks 12-14 and 23: regime, direction and strength against the market.

M is the market close as of each bar's date; windows run over the ticker's own
rows after that alignment.
"""

from __future__ import annotations

from dailybars.features.v3_price import V3, zscore
from dailybars.features.v3_trend import sign_counts
from dailybars.functions.terms import EPS


def m50(p): return p.avg(p.M, 50)
def m200(p): return p.avg(p.M, 200)
def mret(p, k): return p.pct(p.M, k)
def mvol(p): return p.keep(p.std(p.M, 20) / p.M)
def off50(p): return p.keep(p.abs(p.M - m50(p)))
def bull(p): return p.above(p.M, m50(p)) & p.above(m50(p), m200(p))
def bear(p): return p.above(m50(p), p.M) & p.above(m200(p), m50(p))


def against_peak(p, x, size=None):
    """x over the trailing 252-row maximum of its size."""
    x = p.keep(x)
    return x / (p.max(size(x) if size else x, 252) + EPS)


def signed(p, x): return p.clip(against_peak(p, x, p.abs), -1.0, 1.0)


def change_pressure(p):
    stretch = (off50(p) / (p.M + EPS) + p.abs(p.M - m200(p)) / (p.M + EPS)) / 2.0
    sd = p.std(p.M, 20)
    noise = p.unit(sd / (p.avg(sd, 60) + EPS) - 1.0) * 0.3
    turn = p.clip(p.abs(mret(p, 10) - p.avg(mret(p, 10), 20)), 0.0, 0.1) * 5.0
    return p.unit(against_peak(p, stretch + noise + turn))


def trending(p):
    return (bull(p) & (mret(p, 20) > 0.01)) | (bear(p) & (mret(p, 20) < -0.01))


def choppy(p):
    return (off50(p) / p.M < 0.02) & (p.abs(mret(p, 20)) < 0.01) & (mvol(p) > p.avg(mvol(p), 60) * 1.2)


def mood(p):
    tilt = (p.flag(p.above(p.M, m50(p))) * 2.0 - 1.0) * 0.3
    return signed(p, mret(p, 20) * 10.0 + tilt + (p.f("regime_strength") - 0.5) * 0.2)


def fear_greed(p):
    calm = (1.0 - p.fill(p.prank(mvol(p), 252), 0.5)) * 0.4
    return p.unit(calm + p.unit((mret(p, 20) + 0.1) / 0.2) * 0.3 + p.unit((p.M / m200(p) - 0.9) / 0.2) * 0.3)


def flags_agree(p):
    up, down = p.f("bull_market_flag"), p.f("bear_market_flag")
    mean = lambda x: p.avg(x, 20, prev=True)
    score = (1.0 - mean(up * down)) + mean(p.f("trending_market_flag") * (up + down)) + mean(p.f("choppy_market_flag") * (1.0 - up - down))
    return p.unit(p.fill(p.iff(p.rn > 20, score / 3.0, None), 0.5))


def regime_moves(p):
    r = p.f("market_regime")
    return p.flag(r.differs(p.lag(r, 5)) | (p.f("regime_strength") < p.lag(p.f("regime_strength"), 5)) | (p.f("regime_change_probability") > 0.7))


V3.block(
    "12 market regime",
    market_regime=lambda p: p.iff(bear(p), 1.0, p.iff(bull(p), 0.0, 2.0)),
    regime_strength=lambda p: p.unit(against_peak(p, off50(p) / (p.std(p.M, 20) + EPS))),
    regime_duration=lambda p: p.unit(p.run_length(p.f("market_regime").differs(p.lag(p.f("market_regime"))), 252) / 252.0),
    regime_change_probability=change_pressure,
    trending_market_flag=lambda p: p.flag(trending(p)),
    choppy_market_flag=lambda p: p.flag(choppy(p)),
    bull_market_flag=lambda p: p.flag(bull(p)),
    bear_market_flag=lambda p: p.flag(bear(p)),
    market_volatility_regime=lambda p: p.rank_or_half(mvol(p)),
    market_momentum_regime=lambda p: p.unit((mret(p, 20) + 0.1) / 0.2),
    regime_transition=regime_moves,
    regime_stability=lambda p: p.unit((1.0 - p.f("regime_change_probability")) * (1.0 - against_peak(p, mvol(p)))),
    market_sentiment=mood,
    market_fear_greed=fear_greed,
    regime_consistency=flags_agree,
)


def unchanged_share(p, x, w):
    """1 - changes inside the previous w rows / w, its first row counting as one."""
    changed = p.keep(p.flag(x.differs(p.lag(x))))
    n = p.window(f"sum({changed.sql}) {p.frame(-(w - 1), -1)}", [changed], w - 1) + 1.0
    return p.unit(p.fill(p.iff(p.rn > w, 1.0 - n / float(w), None), 0.5))


def direction(p):
    return p.iff(p.above(m50(p), p.M) & (mret(p, 20) < -0.005), 0.0, p.iff(p.above(p.M, m50(p)) & (mret(p, 20) > 0.005), 1.0, 0.5))


def in_range(p):
    lo, hi = p.band(p.M, 20)
    return p.unit((p.M - lo) / (hi - lo))


def rotation(p):
    return signed(p, (mret(p, 5) - mret(p, 20)) * 10.0 + (mvol(p) / (p.avg(mvol(p), 60) + EPS) - 1.0) * 0.5)


def breadth(p):
    move = p.keep(p.abs(mret(p, 1)))
    even = (1.0 - p.std(move, 20) / (p.avg(move, 20) + EPS)) * 0.5
    return p.unit(even + against_peak(p, p.abs(mret(p, 20))) * 0.5)


def leadership(p):
    s, same = sign_counts(p, mret(p, 10), 20, False)
    share = p.iff(p.count(s, 20) >= 1, p.fill(same, 0.0) / p.least(p.rn, 20.0), None)
    return p.unit(share * 0.6 + p.clip(off50(p) / p.M, 0.0, 0.1) * 5.0 * 0.4)


def moves_with(p, a, b): return p.clip(p.fill(p.pcorr20(a, b), 0.0), -1.0, 1.0)


V3.block(
    "13 market direction",
    market_direction=direction,
    market_direction_strength=lambda p: p.unit(against_peak(p, p.abs(mret(p, 20)) * 20.0 + off50(p) / p.M * 5.0)),
    market_trend_alignment=lambda p: moves_with(p, p.roc(1), mret(p, 1)),
    market_momentum=lambda p: signed(p, mret(p, 20) / (mvol(p) + EPS)),
    **V3.same(market_volatility_context="market_volatility_regime"),
    market_timing=lambda p: p.clip((p.f("bull_market_flag") - p.f("bear_market_flag")) * 0.4
                                   + p.f("market_momentum") * 0.3 + p.f("market_sentiment") * 0.3, -1.0, 1.0),
    market_support_resistance=in_range,
    market_regime_consistency=lambda p: unchanged_share(p, p.f("market_regime"), 20),
    market_sector_rotation=rotation,
    market_breadth=breadth,
    market_leadership=leadership,
    market_sentiment_alignment=lambda p: moves_with(p, p.roc(20), mret(p, 20)),
)


def ahead(k):
    return lambda p: p.roc(k) - p.diff(p.M, k) / p.lag(p.M, k)


def strength_rank(p, x, m):
    return p.unit(p.fill(p.prank(x, 252, m) * 100.0, 50.0) / 100.0)


def rs(p): return p.f("relative_strength_spy")


def steadiness(p):
    return p.unit(1.0 - p.std(rs(p), 20, 10) / (p.avg(p.abs(rs(p)), 20, 10) + EPS))


V3.block(
    "14 relative strength",
    relative_strength_spy=ahead(20),
    relative_strength_spy_50d=ahead(50),
    rs_rank_20d=lambda p: strength_rank(p, rs(p), 20),
    rs_rank_50d=lambda p: strength_rank(p, p.f("relative_strength_spy_50d"), 50),
    rs_rank_100d=lambda p: strength_rank(p, ahead(100)(p), 100),
    rs_momentum=lambda p: p.diff(rs(p), 5),
    outperformance_flag=lambda p: p.flag((rs(p) > 0) & (p.f("relative_strength_spy_50d") > 0)),
    rs_vs_price=lambda p: moves_with(p, rs(p), p.roc(20)),
    rs_consistency=steadiness,
    rs_regime=lambda p: p.unit((rs(p) * 0.6 + p.f("relative_strength_spy_50d") * 0.4 + 0.1) / 0.2),
    rs_trend=lambda p: signed(p, p.diff(rs(p), 20) / 0.2),
    rs_acceleration=lambda p: zscore(p, p.diff(rs(p), 5)),
    **V3.same(relative_strength_sector="relative_strength_spy"),
)


def beta(p, m=50):
    """(covariance with the market / market variance + 1) / 4, clipped."""
    rs, rm = p.keep(p.logret(1)), p.keep(p.ln(p.M / p.lag(p.M)))
    cov = p.avg(rs * rm, 252, m) - p.avg(rs, 252, m) * p.avg(rm, 252, m)
    return p.unit((cov / p.var(rm, 252, m) + 1.0) / 4.0)


V3.block(
    "23 market context",
    mkt_spy_dist_sma200=lambda p: zscore(p, p.M / m200(p) - 1.0, 252, 50),
    mkt_spy_sma200_slope=lambda p: p.rank_or_half(p.slope(m200(p), 20, 20), 252, 50, 0.01 * m200(p)),
    beta_spy_252d=beta,
)

# What each feature is when there is no market table.
WITHOUT_MARKET = {
    **dict.fromkeys(["market_regime"], 2.0),
    **dict.fromkeys([
        "regime_strength", "regime_change_probability", "market_volatility_regime", "market_momentum_regime",
        "regime_stability", "market_fear_greed", "market_direction", "market_direction_strength",
        "market_volatility_context", "market_support_resistance", "market_breadth", "market_leadership",
        "rs_rank_100d"], 0.5),
    **dict.fromkeys([
        "trending_market_flag", "choppy_market_flag", "bull_market_flag", "bear_market_flag", "market_sentiment",
        "market_trend_alignment", "market_momentum", "market_timing", "market_sector_rotation",
        "market_sentiment_alignment", "relative_strength_spy", "relative_strength_spy_50d", "price_cointegration",
        "relative_strength_vs_sector"], 0.0),
    **dict.fromkeys(["mkt_spy_dist_sma200", "beta_spy_252d"], None),
}
