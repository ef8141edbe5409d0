"""Feature sets v1 (clipped) and v2 (the same without the outer clips)."""

from __future__ import annotations

from dailybars.features.registry import FeatureSet
from dailybars.features.v3_composite import squeezed
from dailybars.features.v3_market import beta, m200
from dailybars.features.v3_periods import body, lower, reach, upper
from dailybars.features.v3_price import V3, chaikin, position, williams
from dailybars.features.v3_statistics import since_extreme
from dailybars.features.v3_trend import bollinger_width
from dailybars.functions.terms import EPS

V1, V2 = FeatureSet(), FeatureSet()


def both(block_id, **builders):
    V1.block(block_id, **builders)
    V2.block(block_id, **builders)


def clipped(block_id, **pairs):
    """name=(builder, low, high): clipped in v1, as is in v2."""
    for name, (builder, lo, hi) in pairs.items():
        V1.block(block_id, **{name: (lambda p, b=builder, lo=lo, hi=hi: p.clip(b(p), lo, hi))})
        V2.block(block_id, **{name: builder})


def v3(name):
    return V3[name]


def aroon(p, x, highest):
    w = 25
    return p.unit(p.iff(p.count(x, w) >= w, since_extreme(p, x, highest, -(w - 1), 0, w), None))


def fractal(p):
    """1 + ln(path / net + 1) / ln(100) over 100 rows, rescaled from 1..1.8 to 0..1."""
    steps = p.keep(p.abs(p.diff(p.C)))
    ratio = p.sum(steps, 99) / (p.abs(p.C - p.lag(p.C, 99)) + EPS)
    value = p.ln(ratio + 1.0) / p.ln(p.term(100.0))
    return p.unit(p.iff(p.rn >= 100, ((1.0 + value) - 1.0) / (1.8 - 1.0), None))


def rescaled_range(p):
    r = p.keep(p.logret(1))
    full = p.count(r, 100) >= 100
    mean, sd = p.keep(p.avg(r, 100)), p.keep(p.std(r, 100))
    arr = p.values(r, -99, 0)
    spread = p.keep(p.join(p.syntax.cumulative_range(arr.sql, mean.sql), arr, mean))
    rs = p.keep(spread / sd)
    value = p.iff((sd < EPS) | (rs < EPS), 0.5, p.ln(rs) / p.ln(p.term(100.0)))
    return p.unit(p.iff(full & (p.rn > 100), value, None))


def average_bend(p):
    step = p.keep(p.diff(p.avg(p.C, 20)))
    return p.diff(step) / (p.C + EPS)


def volatility_noise(p):
    sd = p.std(p.roc(1), 21)
    return p.std(sd, 21) / (p.avg(sd, 252) + EPS)


def market_distance(p):
    d = p.keep(p.M / (m200(p) + EPS) - 1.0)
    return p.clip((d - p.avg(d, 1260)) / (p.nz(p.std(d, 1260)) + EPS), -3.0, 3.0)


def market_slope_rank(p):
    """2 * share of the trailing 1260 slopes not above the current one - 1."""
    s = p.keep(m200(p) / (p.lag(m200(p), 60) + EPS))
    n = p.count(s, 1260)
    _, upto = p.window_counts(s, 1260)
    share = p.iff(s.is_null(), None, p.iff(n.equals(1), 0.5, upto / n))
    return 2.0 * p.keep(share) - 1.0


def index_of_range(p, w):
    return p.unit(position(p, p.C, p.min(p.L, w), p.max(p.H, w)))


both(
    "price", log_return_1d=v3("log_return_1d"), log_return_5d=v3("weekly_return_1w"),
    price=v3("price"), price_log=v3("price_log"), price_vs_ma200=v3("sma200_ratio"),
)
clipped(
    "returns",
    daily_return=(v3("daily_return"), -0.2, 0.2), gap_pct=(v3("gap_pct"), -0.2, 0.2),
    weekly_return_5d=(v3("weekly_return_5d"), -0.3, 0.3), monthly_return_21d=(v3("monthly_return_21d"), -0.5, 0.5),
    quarterly_return_63d=(v3("quarterly_return_63d"), -1.0, 1.0), ytd_return=(v3("ytd_return"), -1.0, 2.0),
    dist_52w_high=(v3("dist_52w_high"), -1.0, 0.5), dist_52w_low=(v3("dist_52w_low"), -0.5, 2.0),
)


def yearly_position(p):
    lo, hi = p.band(p.C, 252)
    return p.unit((p.C - lo) / p.zero_to(hi - lo, 1))


both("returns", pos_52w=yearly_position)
clipped(
    "averages",
    sma20_ratio=(v3("sma20_ratio"), 0.5, 1.5), sma50_ratio=(v3("sma50_ratio"), 0.5, 1.5),
    sma200_ratio=(v3("sma200_ratio"), 0.5, 2.0), sma20_sma50_ratio=(v3("sma20_sma50_ratio"), 0.8, 1.2),
    sma50_sma200_ratio=(v3("sma50_sma200_ratio"), 0.6, 1.4), sma50_slope=(v3("sma50_slope"), -0.1, 0.1),
    sma200_slope=(v3("sma200_slope"), -0.1, 0.1),
)
clipped(
    "volatility",
    volatility_5d=(v3("volatility_5d"), 0.0, 0.15), volatility_21d=(v3("volatility_21d"), 0.0, 0.15),
    volatility_ratio=(lambda p: p.f("volatility_5d") / (p.f("volatility_21d") + EPS), 0.0, 2.0),
    atr14_normalized=(v3("atr14_normalized"), 0.0, 0.2),
)
both("volume", log_volume=v3("log_volume"), log_avg_volume_20d=v3("log_avg_volume_20d"))
V1.block("volume", relative_volume=lambda p: p.log1p(p.clip(p.V / p.avg(p.V, 20), 0.0, 10.0)))
V2.block("volume", relative_volume=lambda p: p.log1p(p.V / p.avg(p.V, 20)))
both(
    "candles", rsi14=v3("rsi14"),
    candle_body_pct=lambda p: body(p) / reach(p), candle_upper_wick_pct=lambda p: upper(p) / reach(p),
    candle_lower_wick_pct=lambda p: lower(p) / reach(p), higher_high_10d=v3("higher_high_10d"),
    higher_low_10d=v3("higher_low_10d"), swing_low_10d=v3("swing_low_10d"),
)
clipped("oscillators", trend_residual=(v3("trend_residual"), -0.2, 0.2))
both("oscillators", macd_histogram_normalized=v3("macd_histogram_normalized"))
clipped(
    "oscillators",
    ppo_histogram=(v3("ppo_histogram"), -0.2, 0.2),
    dpo=(lambda p: (p.C - p.lag(p.avg(p.C, 20, 20), 11)) / p.C, -0.2, 0.2),
    roc10=(v3("roc10"), -0.5, 0.5), roc20=(v3("roc20"), -0.7, 0.7),
)
both(
    "oscillators",
    stochastic_k14=lambda p: index_of_range(p, 14), bollinger_band_width=lambda p: p.log1p(bollinger_width(p)),
    adx14=v3("adx14"), chaikin_money_flow=chaikin,
)
both(
    "channels",
    donchian_position=lambda p: index_of_range(p, 20),
    donchian_breakout=lambda p: p.flag(p.C > p.lag(p.max(p.C, 20, 20))),
    ttm_squeeze_on=lambda p: p.flag(squeezed(p)), ttm_squeeze_momentum=v3("ttm_squeeze_momentum"),
)
clipped("channels", obv_momentum=(v3("obv_momentum"), -0.5, 0.5))
both(
    "channels",
    aroon_up=lambda p: aroon(p, p.H, True), aroon_down=lambda p: aroon(p, p.L, False),
    aroon_oscillator=lambda p: p.unit((p.f("aroon_up") * 100.0 - p.f("aroon_down") * 100.0 + 100.0) / 200.0),
    cci20=v3("cci20"), williams_r14=williams,
)
clipped("adaptive", kama_slope=(v3("kama_slope"), -0.1, 0.1))
both("adaptive", beta_spy_252d=lambda p: beta(p, 1), fractal_dimension_index=fractal, hurst_exponent=rescaled_range)
clipped(
    "adaptive",
    price_curvature=(average_bend, -0.05, 0.05), volatility_of_volatility=(volatility_noise, 0.0, 3.0),
)
both("market", mkt_spy_dist_sma200=market_distance, mkt_spy_sma200_slope=market_slope_rank)
