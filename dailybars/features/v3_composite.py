"""v3 blocks 20-22 and 24-28: interactions, gain and signal scores, composites."""

from __future__ import annotations

from dailybars.features.v3_market import against_peak, mvol
from dailybars.features.v3_price import V3, zscore
from dailybars.features.v3_statistics import share_of_peak
from dailybars.features.v3_trend import bollinger_width, variance_of
from dailybars.functions.terms import EPS

TARGET = 0.15


def product(a, b):
    return lambda p: p.f(a) * p.f(b)


def tilt(p):
    """market regime 0, 1, 2 as -1, 0, 1"""
    return (p.f("market_regime") - 1.0) / 1.0


def rs_position(p):
    return p.minmax(p.f("relative_strength_spy"))


V3.block(
    "20 interactions",
    rsi_x_volume=product("rsi14", "relative_volume"),
    rsi_x_atr=product("rsi14", "atr14_normalized"),
    macd_x_volume=product("macd_histogram_normalized", "relative_volume"),
    trend_x_momentum=product("trend_strength_20d", "momentum_20d"),
    volume_x_momentum=product("relative_volume", "momentum_20d"),
    rsi_x_trend_strength=product("rsi14", "trend_strength_20d"),
    volatility_x_volume=product("volatility_21d", "relative_volume"),
    volatility_x_trend=product("volatility_21d", "trend_strength_20d"),
    **V3.same(trend_x_volatility="volatility_x_trend"),
    volatility_x_regime_strength=product("volatility_21d", "regime_strength"),
    price_position_x_rsi=product("close_position_in_range", "rsi14"),
    support_resistance_x_momentum=lambda p: (p.f("distance_to_support") + p.f("distance_to_resistance")) / 2.0 * p.f("momentum_20d"),
    rsi_x_support_distance=product("rsi14", "distance_to_support"),
    volume_x_breakout=product("relative_volume", "donchian_breakout"),
    momentum_x_regime=lambda p: p.f("momentum_20d") * tilt(p),
    volume_x_regime=lambda p: p.f("relative_volume") * tilt(p),
    rsi_x_relative_strength=lambda p: p.f("rsi14") * rs_position(p),
    trend_x_relative_strength=lambda p: p.f("trend_strength_20d") * rs_position(p),
    momentum_x_time=product("momentum_20d", "day_of_week_sin"),
    volume_x_time=product("relative_volume", "day_of_week_sin"),
)


def around(p, name): return p.unit((p.f(name) + 0.1) / 0.2)
def halved(p, x): return p.unit((x + 1.0) / 2.0)
def momentum(p): return around(p, "momentum_20d")
def trend(p): return p.f("trend_strength_20d")
def volume(p): return share_of_peak(p, p.f("relative_volume"))
def volatility(p): return share_of_peak(p, p.f("volatility_21d"))
def support(p): return around(p, "distance_to_support")


def past_gain_share(p):
    """Share of rows i-252..i-21 whose 20-row high reached the target from the close 20 rows before."""
    hit = p.keep(p.flag(p.max(p.H, 20) / p.lag(p.C, 20) - 1.0 >= TARGET))
    share = p.window(f"avg({hit.sql}) {p.frame(-252, -21)}", [hit], 252)
    return p.iff(p.rn > 272, share, 0.0)


def gain_score(p):
    return p.unit(p.f("historical_gain_probability") * 0.4 + momentum(p) * 0.3 + trend(p) * 0.2 + volume(p) * 0.1)


def timing(p):
    calm = p.unit(1.0 - p.f("volatility_21d") / (p.max(p.f("volatility_21d"), 252) + EPS))
    return p.unit(momentum(p) * 0.3 + trend(p) * 0.25 + volume(p) * 0.2 + calm * 0.15 + support(p) * 0.1)


def swing_risk(p):
    return (p.C - p.f("swing_low_10d")) / p.C + EPS


def volume_confirms(p):
    return p.unit(volume(p) * 0.5 + halved(p, p.f("volume_trend")) * 0.3 + halved(p, p.f("volume_momentum")) * 0.2)


def trend_aligned(p):
    return p.unit(trend(p) * 0.4 + p.f("trend_consistency") * 0.3 + p.flag(p.f("momentum_20d") > 0) * 0.3)


def mid_volatility(p):
    off = p.keep(p.fill(p.prank(p.f("volatility_21d"), 252), 0.5) - 0.5)
    return p.unit(1.0 - 4.0 * (off * off))


V3.block(
    "21 gain",
    historical_gain_probability=past_gain_share,
    gain_probability_score=gain_score,
    gain_regime=lambda p: p.rank_or_half(p.f("gain_probability_score"), 252, 50),
    gain_consistency=lambda p: share_of_peak(p, 1.0 / (p.var(p.f("historical_gain_probability"), 252, 50) + EPS)),
    gain_timing=timing,
    gain_momentum=lambda p: p.f("momentum_20d") / 20.0 / (TARGET / 20 + EPS),
    gain_acceleration=lambda p: p.diff(p.f("gain_momentum"), 5),
    target_distance=lambda p: (p.C * (1.0 + TARGET) - p.C) / p.C,
    gain_momentum_strength=lambda p: p.unit(
        p.unit(against_peak(p, p.f("gain_momentum"), p.abs)) * 0.5 + trend(p) * 0.3 + volume(p) * 0.2),
    gain_breakout_signal=lambda p: p.unit(p.f("donchian_breakout") * 0.4 + momentum(p) * 0.35 + volume(p) * 0.25),
    gain_risk_ratio=lambda p: TARGET / swing_risk(p),
    gain_volume_confirmation=volume_confirms,
    gain_trend_alignment=trend_aligned,
    gain_volatility_context=mid_volatility,
    gain_support_level=lambda p: p.unit(
        support(p) * 0.3 + p.f("support_resistance_strength") * 0.4 + share_of_peak(p, p.f("support_touches")) * 0.3),
)


def agreement(p):
    spread = variance_of(p, p.f("rsi14") / 100.0, halved(p, p.f("macd_signal")), momentum(p), trend(p))
    return share_of_peak(p, 1.0 / (spread + EPS))


def confirmations(p):
    tests = [p.f("rsi14") > 50, p.f("macd_signal") > 0, p.f("momentum_20d") > 0,
             p.f("relative_volume") > 1.0, p.f("donchian_breakout") > 0.5]
    return p.unit(sum((p.flag(t) for t in tests), p.term(0.0)) / 5.0)


def quality_score(p):
    reward = halved(p, against_peak(p, p.f("signal_risk_reward"), p.abs))
    return p.unit(p.f("signal_consistency") * 0.25 + p.f("signal_confirmation") * 0.25 + p.f("signal_strength") * 0.2
                  + p.f("signal_timing") * 0.15 + reward * 0.15)


def significance(p):
    return p.unit(1.0 / (1.0 + p.exp(-zscore(p, p.f("signal_strength"), 252, 50))))


def false_alarm(p):
    return p.unit((1.0 - p.f("signal_confirmation")) * 0.3 + (1.0 - p.f("signal_strength")) * 0.3
                  + (1.0 - p.f("signal_timing")) * 0.2 + volatility(p) * 0.2)


def regime_aligned(p):
    regime = p.keep(p.fill(p.f("market_regime"), 2.0))
    score = p.iff(regime.equals(2), 0.5, p.iff(regime.equals(1), 0.0, p.iff(regime.equals(0), 1.0, 0.5)))
    strength = halved(p, p.fill(p.f("relative_strength_spy"), 0.0))
    return p.unit(score * 0.4 + p.fill(p.f("regime_strength"), 0.5) * 0.3 + strength * 0.3)


def momentum_signal(p):
    size = p.unit((p.abs(p.f("momentum_20d")) + 0.1) / 0.2)
    return p.unit(size * 0.4 + share_of_peak(p, p.f("momentum_persistence")) * 0.35 + halved(p, p.f("momentum_acceleration")) * 0.25)


def timeframes(p):
    monthly = halved(p, against_peak(p, p.base("mo_sma3_step"), p.abs))
    return p.unit(p.fill(trend(p), 0.5) * 0.5 + p.fill(p.f("weekly_trend_strength"), 0.5) * 0.3 + p.fill(monthly, 0.5) * 0.2)


def level_signal(p):
    return p.unit(support(p) * 0.4 + p.f("support_resistance_strength") * 0.4 + (1.0 - around(p, "distance_to_resistance")) * 0.2)


V3.block(
    "22 signals",
    signal_quality_score=quality_score,
    signal_strength=lambda p: p.unit(momentum(p) * 0.3 + trend(p) * 0.3 + volume(p) * 0.2 + halved(p, p.f("pattern_strength")) * 0.2),
    signal_consistency=agreement,
    signal_confirmation=confirmations,
    **V3.same(signal_timing="gain_timing"),
    signal_risk_reward=lambda p: p.abs(p.f("momentum_20d")) / swing_risk(p),
    signal_statistical_significance=significance,
    signal_historical_success=lambda p: p.rank_or_half(p.f("signal_strength"), 252, 50),
    signal_ensemble_score=lambda p: p.unit(
        p.f("signal_quality_score") * 0.3 + p.f("signal_strength") * 0.25 + p.f("signal_confirmation") * 0.2
        + p.f("signal_timing") * 0.15 + p.f("signal_historical_success") * 0.1),
    false_positive_risk=false_alarm,
    signal_divergence=lambda p: p.unit(p.fill((p.corr(p.roc(5), p.diff(p.f("rsi14"), 5), 20, 10) + 1.0) / 2.0, 0.5)),
    **V3.same(signal_volume_confirmation="gain_volume_confirmation", signal_trend_alignment="gain_trend_alignment",
              signal_volatility_context="gain_volatility_context"),
    signal_regime_alignment=regime_aligned,
    signal_momentum_strength=momentum_signal,
    signal_support_resistance=level_signal,
    signal_relative_strength=lambda p: p.unit(
        halved(p, p.fill(p.f("relative_strength_spy"), 0.0)) * 0.6 + halved(p, p.fill(p.f("rs_momentum"), 0.0)) * 0.4),
    signal_multi_timeframe=timeframes,
    signal_pattern_confirmation=lambda p: p.unit(halved(p, p.f("pattern_strength")) * 0.6 + p.f("pattern_confirmation") * 0.4),
)


def squeezed(p):
    """Bollinger band (2 deviations) inside the Keltner channel (1.5 ranges)."""
    mid, sd, tr = p.avg(p.C, 20), p.std(p.C, 20), p.atr(20)
    return ((mid - 2.0 * sd) > (mid - 1.5 * tr)) & ((mid + 2.0 * sd) < (mid + 1.5 * tr))


V3.block(
    "24 channels",
    ttm_squeeze_on=lambda p: p.flag(squeezed(p)),
    ttm_squeeze_momentum=lambda p: (p.C - p.avg(p.C, 20)) / p.C,
)


def resting(p):
    mid, width = p.avg(p.C, 50), p.keep(p.max(p.H, 10) - p.min(p.L, 10))
    tight = width < p.avg(width, 50) * 0.7
    no_high, no_low = ~(p.H >= p.lag(p.max(p.H, 20))), ~(p.L <= p.lag(p.min(p.L, 20)))
    return p.flag((p.above(p.C, mid) & tight & no_high) | (p.above(mid, p.C) & tight & no_low))


def exhausted(p):
    gap = p.keep(p.abs((p.C - p.avg(p.C, 50)) / p.avg(p.C, 50)))
    r = p.f("rsi14")
    return p.unit(p.flag(p.f("momentum_acceleration") < 0) * 0.3 + p.flag(p.f("relative_volume") < 0.8) * 0.25
                  + p.flag((r > 70) | (r < 30)) * 0.25 + p.flag(p.above(gap, p.quantile(gap, 0.75, 252))) * 0.2)


def trend_or_revert(p):
    centred = p.unit(1.0 - p.abs(p.f("donchian_position") - 0.5) * 2.0)
    return p.unit(trend(p) * 0.35 + p.fill(p.prank(p.f("volatility_21d"), 252), 0.5) * 0.25 + centred * 0.2
                  + share_of_peak(p, p.f("momentum_persistence")) * 0.2)


V3.block(
    "25 exhaustion",
    trend_consolidation=resting,
    trend_exhaustion=exhausted,
    trend_vs_mean_reversion=trend_or_revert,
    volatility_jump=lambda p: p.rank_or_half(
        p.avg(p.f("volatility_21d"), 5) / (p.avg(p.f("volatility_21d"), 50) + EPS), 252, 50),
)


def seen(p): return p.f("realized_volatility_20d")
def guess(p): return p.f("volatility_forecast")


def accuracy(p):
    miss = p.avg(p.abs(seen(p) - guess(p)), 21)
    size = p.avg(seen(p), 21)
    return p.unit(p.fill(p.iff(p.rn > 20, p.iff(size > 0, 1.0 - miss / (size + EPS), 0.5), 0.5), 0.5))


def clustered(p):
    v = p.f("volatility_21d")
    r = p.corr(v, p.lag(v), 50)
    return p.unit((p.fill(p.iff(p.rn > 50, r, 0.5), 0.5) + 1.0) / 2.0)


V3.block(
    "26.1 forecast",
    volatility_forecast_accuracy=accuracy,
    volatility_forecast_error=lambda p: p.abs(seen(p) - guess(p)) / (guess(p) + EPS),
    volatility_forecast_error_true=lambda p: p.fill(p.abs(seen(p) - p.lag(guess(p), 20)) / (p.lag(guess(p), 20) + EPS), 0.0),
    volatility_forecast_trend=lambda p: p.fill(p.slope(guess(p), 7, 2), 0.0),
    volatility_clustering_strength=clustered,
    volatility_regime_forecast=lambda p: p.unit(
        p.f("volatility_regime") / 100.0 * 0.6 + p.unit(p.fill(p.minmax(p.f("volatility_forecast_trend")), 0.5)) * 0.4),
    volatility_surprise=lambda p: (seen(p) - guess(p)) / (guess(p) + EPS),
    volatility_realized_forecast_ratio=lambda p: seen(p) / (guess(p) + EPS),
)


def slope_position(name):
    return lambda p: p.unit(p.fill(p.minmax(p.slope(p.f(name), 10, 2)), 0.5))


V3.block(
    "26.2 gain trend",
    gain_probability_trend=slope_position("gain_probability_score"),
    gain_probability_consistency_rank=lambda p: p.rank_or_half(p.f("gain_consistency"), 252, 20),
    gain_probability_volatility_adjusted=lambda p: p.f("gain_probability_score") / (guess(p) + EPS),
)
V3.block("26.3 distance rank", dist_support_rank=lambda p: p.rank_or_half(p.f("distance_to_support"), 252, 20))
V3.block(
    "26.4 ranks",
    volatility_rank=lambda p: p.rank_or_half(p.f("volatility_21d"), 252, 20),
    return_rank_3m=lambda p: p.rank_or_half(p.f("monthly_return_3m"), 252, 20),
    momentum_rank_trend=slope_position("momentum_rank"),
)
V3.block(
    "26.5 volatility and volume",
    volatility_volume_correlation=lambda p: p.unit(p.fill((p.corr(p.f("volatility_21d"), p.V, 20, 5) + 1.0) / 2.0, 0.5)),
    volatility_volume_divergence=lambda p: p.unit(1.0 - p.f("volatility_volume_correlation")),
    volatility_forecast_volume_confirmation=lambda p: guess(p) * p.f("relative_volume"),
)
V3.block("26.6 return and volatility", return_volatility_ratio=lambda p: p.f("monthly_return_3m") / (p.f("volatility_21d") + EPS))


def turning(p, run, moved):
    """60% run length, 40% recent change, each over its trailing yearly maximum."""
    change = p.keep(p.abs(p.diff(moved)))
    return p.unit(p.fill(against_peak(p, run) * 0.6 + against_peak(p, change) * 0.4, 0.5))


V3.block(
    "26.7 regime turns",
    volatility_regime_transition_probability=lambda p: turning(p, p.base("run_vr"), p.f("volatility_regime")),
    gain_regime_transition_probability=lambda p: turning(p, p.base("run_gr"), p.f("gain_probability_score")),
    momentum_regime_transition=lambda p: p.flag(p.abs(p.diff(p.f("momentum_regime"))) > 0.3),
)


def ensemble(p):
    parts = p.minmax(guess(p)) * 0.4 + p.minmax(p.f("volatility_21d")) * 0.3 + p.minmax(p.f("volume_imbalance")) * 0.15
    return p.unit(p.fill(parts + p.f("gain_probability_score") * 0.1 + p.f("momentum_rank") * 0.05, 0.5))


V3.block(
    "26.8 ensembles",
    top_features_ensemble=ensemble,
    volatility_forecast_accuracy_weighted=product("volatility_forecast", "volatility_forecast_accuracy"),
    gain_probability_volatility_regime_interaction=lambda p: p.unit(
        p.f("gain_probability_score") * (p.f("volatility_regime") / 100.0)),
)


def monthly_vwap(p):
    price = p.keep(p.sum(p.C * p.V, 21) / p.sum(p.V, 21))
    return p.fill(p.diff(price, 5) / (price + EPS), 0.0)


def channel_position(p):
    mid, reach = p.base("k_ema20"), p.keep(1.5 * p.atr(20))
    return p.clip((p.C - (mid - reach)) / ((mid + reach) - (mid - reach) + EPS), -1.0, 2.0)


def volume_price_divergence(p):
    trend_line = p.sum(p.V * p.fill(p.roc(1), 0.0), 60)
    r = p.corr(p.fill(p.roc(10), 0.0), p.fill(p.pct(trend_line, 10), 0.0), 10, 3)
    return p.unit(p.fill(1.0 - (r + 1.0) / 2.0, 0.5))


V3.block(
    "27 precision",
    adr_percentage=lambda p: p.avg((p.H - p.L) / p.C, 14),
    monthly_vwap_slope=monthly_vwap,
    atr_channel_position=channel_position,
    vpt_divergence=volume_price_divergence,
    relative_strength_vs_sector=lambda p: p.fill(p.roc(20) - p.pct(p.S, 20), 0.0),
)


def straightness(p):
    """Squared correlation of the previous 15 closes with time."""
    r = p.corr(p.C, p.rn, 15, prev=True)
    return p.unit(p.fill(p.iff(p.rn > 15, r * r, None), 0.0))


V3.block(
    "28 precision 2",
    intraday_intensity=lambda p: p.unit(p.avg(p.fill((p.C - p.L) / (p.nz(p.H - p.L) + EPS), 0.5), 5)),
    volume_climax_ratio=lambda p: p.clip(p.V / (p.avg(p.V, 50) + EPS), 0.0, 10.0),
    momentum_quality_r2=straightness,
    atr_expansion_ratio=lambda p: p.atr(5) / (p.atr(50) + EPS),
    relative_strength_momentum=lambda p: p.fill(zscore(p, p.diff(p.f("relative_strength_vs_sector"), 5)), 0.0),
)
