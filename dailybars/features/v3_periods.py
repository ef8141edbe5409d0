"""v3 blocks 8-11 and 15: weekly and monthly series, candles, streaks, calendar."""

from __future__ import annotations

import math

from dailybars.features.registry import FeatureSet
from dailybars.features.v3_price import V3, first_of_year, position
from dailybars.functions.terms import EPS

# Series with one row per week or month, evaluated on the resampled bars and
# visible from the period's last day on (columns wk_* and mo_* of the daily sheet).
WEEKLY = FeatureSet()
WEEKLY.block(
    "weekly",
    wk_volume=lambda w: w.V / (w.avg(w.V, 20) + EPS),
    **{f"wk_sma{n}": (lambda w, n=n: w.avg(w.C, n)) for n in (5, 10, 20)},
    **{f"wk_ema{n}": (lambda w, n=n: w.base(f"k_ema{n}")) for n in (5, 10, 20)},
    wk_rsi14=lambda w: (w.rsi(14) - 50.0) / 50.0,
    wk_rsi7=lambda w: (w.rsi(7) - 50.0) / 50.0,
    wk_macd_hist=lambda w: w.base("k_ema12") - w.base("k_ema26") - w.base("k_macd_sig"),
    wk_macd_sig=lambda w: w.base("k_macd_sig"),
    wk_adx=lambda w: w.base("k_adx14"),
    wk_stoch=lambda w: w.unit(w.fill(position(w, w.C, w.min(w.L, 14), w.max(w.H, 14)), 0.5)),
    wk_atr=lambda w: w.atr(14),
    wk_close=lambda w: w.C,
)
MONTHLY = FeatureSet()
MONTHLY.block(
    "monthly",
    mo_sma3=lambda m: m.avg(m.C, 3),
    mo_sma6=lambda m: m.avg(m.C, 6),
    mo_rsi=lambda m: (m.rsi(14) - 50.0) / 50.0,
    mo_close=lambda m: m.C,
    mo_sma3_step=lambda m: m.diff(m.avg(m.C, 3), 1),
)

V3.block(
    "8.1 weekly returns",
    weekly_return_2w=lambda p: p.logret(10),
    weekly_return_4w=lambda p: p.logret(20),
    weekly_volume_ratio=lambda p: p.base("wk_volume"),
)
V3.block(
    "8.2 weekly averages",
    **{f"weekly_{kind}_{n}w": (lambda p, kind=kind, n=n: p.base(f"wk_{kind}{n}") / p.C)
       for kind in ("sma", "ema") for n in (5, 10, 20)},
)
V3.block(
    "8.3 weekly indicators",
    weekly_rsi_14w=lambda p: p.base("wk_rsi14"),
    weekly_rsi_7w=lambda p: p.base("wk_rsi7"),
    weekly_macd_histogram=lambda p: p.base("wk_macd_hist") / p.C,
    weekly_macd_signal=lambda p: p.base("wk_macd_sig") / p.C,
    weekly_adx=lambda p: p.base("wk_adx"),
    weekly_stochastic=lambda p: p.base("wk_stoch"),
)
V3.block(
    "8.4 weekly comparisons",
    close_vs_weekly_sma20=lambda p: p.C / (p.base("wk_sma20") + EPS),
    close_vs_weekly_ema20=lambda p: p.C / (p.base("wk_ema20") + EPS),
    weekly_atr_pct=lambda p: p.base("wk_atr") / p.C,
    weekly_trend_strength=lambda p: p.diff(p.base("wk_sma20"), 5) / p.C,
    **V3.same(weekly_momentum="momentum_20d"),
)
V3.block(
    "9 monthly",
    monthly_return_1m=lambda p: p.logret(21),
    monthly_return_3m=lambda p: p.logret(63),
    monthly_sma_3m=lambda p: p.base("mo_sma3") / p.C,
    monthly_sma_6m=lambda p: p.base("mo_sma6") / p.C,
    monthly_rsi=lambda p: p.base("mo_rsi"),
)


def body(p): return p.keep(p.abs(p.C - p.O))
def reach(p): return p.keep(p.H - p.L)
def upper(p): return p.keep(p.H - p.greatest(p.C, p.O))
def lower(p): return p.keep(p.least(p.C, p.O) - p.L)
def body_share(p): return p.keep(body(p) / (reach(p) + EPS))


V3.block(
    "10.1 candle parts",
    candle_body_pct=lambda p: p.unit(body(p) / reach(p)),
    candle_upper_wick_pct=lambda p: p.unit(upper(p) / reach(p)),
    candle_lower_wick_pct=lambda p: p.unit(lower(p) / reach(p)),
    candle_wicks_ratio=lambda p: p.f("candle_upper_wick_pct") / (p.f("candle_lower_wick_pct") + EPS),
)


def small_body(p): return body_share(p) < 0.3
def long_tail(p, tail, other): return small_body(p) & (tail(p) > 2.0 * body(p)) & (other(p) < 0.5 * body(p))
def red_before(p): return p.lag(p.C) < p.lag(p.O)
def green_before(p): return p.lag(p.C) > p.lag(p.O)
def mid_before(p): return (p.lag(p.H) + p.lag(p.L)) / 2.0
def inside(p): return (p.H < p.lag(p.H)) & (p.L > p.lag(p.L))
def much_wider_before(p): return (p.lag(p.H) - p.lag(p.L)) > reach(p) * 1.5


V3.block(
    "10.2 reversal patterns",
    hanging_man=lambda p: p.flag(long_tail(p, lower, upper)),
    inverted_hammer=lambda p: p.flag(long_tail(p, upper, lower)),
    piercing_pattern=lambda p: p.flag(red_before(p) & (p.O < p.lag(p.C)) & (p.C > mid_before(p))),
    dark_cloud_cover=lambda p: p.flag(green_before(p) & (p.O > p.lag(p.C)) & (p.C < mid_before(p))),
    harami_bullish=lambda p: p.flag(red_before(p) & much_wider_before(p) & inside(p)),
    harami_bearish=lambda p: p.flag(green_before(p) & much_wider_before(p) & inside(p)),
    engulfing_bullish=lambda p: p.flag(red_before(p) & (p.C > p.O) & (p.O < p.lag(p.C)) & (p.C > p.lag(p.O))),
    engulfing_bearish=lambda p: p.flag(green_before(p) & (p.C < p.O) & (p.O > p.lag(p.C)) & (p.C < p.lag(p.O))),
)


def three_in_a_row(p, rising):
    c, o = [p.C, p.lag(p.C), p.lag(p.C, 2)], [p.O, p.lag(p.O), p.lag(p.O, 2)]
    more = (lambda a, b: a > b) if rising else (lambda a, b: a < b)
    return p.flag(more(c[2], o[2]) & more(c[1], o[1]) & more(c[0], o[0]) & more(c[1], c[2]) & more(c[0], c[1]))


V3.block(
    "10.3 continuation patterns",
    three_white_soldiers=lambda p: three_in_a_row(p, True),
    three_black_crows=lambda p: three_in_a_row(p, False),
    inside_bar=lambda p: p.flag(inside(p)),
    outside_bar=lambda p: p.flag((p.H > p.lag(p.H)) & (p.L < p.lag(p.L))),
    engulfing_strength=lambda p: p.diff(reach(p)) / (p.lag(reach(p)) + EPS),
)
V3.block(
    "10.4 single candles",
    doji=lambda p: p.flag(body_share(p) < 0.05),
    hammer=lambda p: p.flag(long_tail(p, lower, upper) & (p.C > p.O)),
    shooting_star=lambda p: p.flag(long_tail(p, upper, lower) & (p.C < p.O)),
    marubozu=lambda p: p.flag(body_share(p) > 0.95),
    spinning_top=lambda p: p.flag(small_body(p) & (lower(p) > 1.5 * body(p)) & (upper(p) > 1.5 * body(p))),
)

BULLISH = ("inverted_hammer", "piercing_pattern", "harami_bullish", "engulfing_bullish", "three_white_soldiers", "hammer")
BEARISH = ("hanging_man", "dark_cloud_cover", "harami_bearish", "engulfing_bearish", "three_black_crows", "shooting_star")
NEUTRAL = ("inside_bar", "outside_bar", "doji", "marubozu", "spinning_top")


def total(p, names):
    return sum((p.f(n) for n in names), p.term(0.0))


V3.block(
    "10.5 pattern quality",
    pattern_strength=lambda p: total(p, BULLISH) - total(p, BEARISH),
    pattern_confirmation=lambda p: p.pcorr20(p.f("pattern_strength"), p.roc(5)),
    pattern_divergence=lambda p: p.pcorr20(p.f("pattern_strength"), p.roc(10)),
)


def streak(p, holds):
    """Length of the current run of rows on which ``holds``, over 20, at most 1."""
    on = p.keep(p.flag(holds))
    return p.unit(p.iff(on.equals(1), p.run_length(on.differs(p.lag(on)), 20), 0.0) / 20.0)


V3.block(
    "11 price action",
    consecutive_green_days=lambda p: streak(p, p.roc(1) > 0),
    consecutive_red_days=lambda p: streak(p, p.roc(1) < 0),
    higher_high_10d=lambda p: p.flag(p.C > p.max(p.lag(p.C), 10)),
    higher_low_10d=lambda p: p.flag(p.C > p.min(p.lag(p.C), 10)),
    swing_low_10d=lambda p: p.min(p.lag(p.L), 10),
    pattern_cluster=lambda p: p.unit(total(p, BULLISH + BEARISH + NEUTRAL) / 10.0),
)


def angle(p, part, period):
    value = p.join(p.syntax.weekday("date"), p.date) if part == "weekday" else p.join(f"cast({part}(date) as double)", p.date)
    return p.keep(2 * math.pi * value / float(period))


def wave(part, period, *shapes):
    return lambda p: sum((getattr(p, s)(angle(p, part, period)) for s in shapes[1:]), getattr(p, shapes[0])(angle(p, part, period)))


def days_left(p):
    return p.keep(p.join(p.syntax.days_left("date"), p.date))


def month_of(p):
    return p.keep(p.join("cast(month(date) as double)", p.date))


def day_ordinal(p):
    return p.rn - first_of_year(p, p.rn) + 1.0


V3.block(
    "15 calendar",
    day_of_week=wave("weekday", 7, "sin", "cos"),
    day_of_week_sin=wave("weekday", 7, "sin"),
    day_of_week_cos=wave("weekday", 7, "cos"),
    day_of_month=wave("day", 31, "sin", "cos"),
    day_of_month_sin=wave("day", 31, "sin"),
    day_of_month_cos=wave("day", 31, "cos"),
    month_of_year=wave("month", 12, "sin", "cos"),
    month_of_year_sin=wave("month", 12, "sin"),
    month_of_year_cos=wave("month", 12, "cos"),
    quarter=wave("quarter", 4, "sin", "cos"),
    is_month_end=lambda p: p.flag(days_left(p) <= 2),
    is_quarter_end=lambda p: p.flag(((month_of(p) / 3.0).equals(p.call("floor", month_of(p) / 3.0))) & (days_left(p) <= 4)),
    is_year_end=lambda p: p.flag(month_of(p).equals(12)),
    trading_day_of_year=lambda p: p.unit(day_ordinal(p) / 252.0),
)
