"""v3 blocks 3-7: momentum, volatility, trend, levels, volume profile."""

from __future__ import annotations

import math

from dailybars.features.v3_price import V3, position
from dailybars.functions.terms import EPS


def ultimate(p):
    buying = p.keep(p.C - p.least(p.L, p.lag(p.C)))
    tr = p.true_range()
    weigh = lambda x: 4.0 * p.sum(x, 7) + 2.0 * p.sum(x, 14) + p.sum(x, 28)
    return (100.0 * weigh(buying) / weigh(tr) - 50.0) / 50.0


def momentum(k):
    return lambda p: p.diff(p.C, k) / p.C


V3.block(
    "3.1 momentum oscillators",
    ultimate_oscillator=ultimate,
    awesome_oscillator=lambda p: (p.avg(p.C, 5) - p.avg(p.C, 34)) / p.C,
    momentum_20d=momentum(20),
    momentum_50d=momentum(50),
)


def spread_of(p, *xs):
    """Sample standard deviation across columns, null ones skipped."""
    return p.sqrt(p.greatest(variance_of(p, *xs), 0.0))


def variance_of(p, *xs):
    xs = [p.keep(x) for x in xs]
    n = p.keep(sum((p.iff(x.is_null(), 0.0, 1.0) for x in xs), p.term(0.0)))
    mean = p.keep(sum((p.fill(x, 0.0) for x in xs), p.term(0.0)) / n)
    total = sum((p.fill((x - mean) * (x - mean), 0.0) for x in xs), p.term(0.0))
    return p.keep(p.iff(n > 1, total / (n - 1.0), None))


def rsi_agreement(p):
    xs = [p.f(n) for n in ("rsi7", "rsi14", "rsi21")]
    n = sum((p.iff(x.is_null(), 0.0, 1.0) for x in xs), p.term(0.0))
    size = sum((p.fill(p.abs(x), 0.0) for x in xs), p.term(0.0)) / n
    return 1.0 - spread_of(p, *xs) / (size + EPS)


def sign_counts(p, x, w, prev):
    """How many rows of the window share the current row's sign."""
    s = p.keep(p.sign(x))
    total = lambda v: p.sum(p.flag(s.equals(v)), w, prev=prev)
    up, down, flat = total(1), total(-1), total(0)
    return s, p.iff(s.equals(1), up, p.iff(s.equals(-1), down, p.iff(s.equals(0), flat, 0.0)))


def persistence(p):
    s, same = sign_counts(p, p.roc(10), 19, True)
    share = p.iff(s.equals(0), 0.0, p.fill(same, 0.0) / (p.least(p.rn, 20.0) - 1.0))
    return p.iff(p.count(s, 20) >= 5, share, None)


def exhaustion(p):
    r, d = p.f("rsi14"), p.f("rsi_momentum")
    return p.iff(((r < -0.4) & (d > 0)) | ((r > 0.4) & (d < 0)), r, 0.0)


def macd_turn(p):
    h = p.f("macd_histogram_normalized")
    before = p.lag(h)
    return p.iff(((before > 0) & (h < 0)) | ((before < 0) & (h > 0)), h, 0.0)


V3.block(
    "3.2 momentum quality",
    momentum_divergence=lambda p: p.pcorr20(p.diff(p.f("rsi14")), p.roc(1)),
    momentum_consistency=rsi_agreement,
    momentum_acceleration=lambda p: p.diff(p.roc(10), 5),
    momentum_strength=lambda p: p.sqrt(p.f("rsi14") * p.f("rsi14") + p.f("macd_histogram_normalized").squared()),
    momentum_persistence=persistence,
    momentum_exhaustion=exhaustion,
    momentum_reversal_signal=macd_turn,
    momentum_cross=lambda p: p.roc(5) - p.roc(20),
    momentum_rank=lambda p: p.rank_or_half(p.roc(10), 252, 20),
    momentum_regime=lambda p: 0.4 * p.f("rsi14") + 0.4 * p.f("macd_histogram_normalized") + 0.2 * p.clip(p.roc(20), -1.0, 1.0),
)
V3.block(
    "3.3 momentum variants",
    momentum_5d=momentum(5),
    momentum_15d=momentum(15),
    momentum_30d=momentum(30),
    momentum_vs_price=lambda p: p.pcorr20(p.roc(10), p.roc(1)),
)


def bollinger_width(p):
    mid, sd = p.avg(p.C, 20), p.std(p.C, 20)
    return p.keep(((mid + 2.0 * sd) - (mid - 2.0 * sd)) / mid)


def atr_rank(w, m):
    return lambda p: p.rank_or_half(p.atr(14), w, m)


def squeeze(p):
    width = bollinger_width(p)
    return width / (p.avg(width, 20) + EPS)


V3.block(
    "4.1 volatility regime",
    volatility_regime=atr_rank(252, 20),
    volatility_trend=lambda p: p.diff(p.atr(14), 10) / (p.atr(14) + EPS),
    bb_squeeze=squeeze,
    **V3.same(bb_expansion="bb_squeeze"),
    atr_ratio_20d=lambda p: p.atr(14) / (p.avg(p.atr(14), 20) + EPS),
    atr_ratio_252d=lambda p: p.atr(14) / (p.avg(p.atr(14), 252, 20) + EPS),
    volatility_percentile_20d=atr_rank(20, 5),
    volatility_percentile_252d=atr_rank(252, 20),
    high_volatility_flag=lambda p: p.flag(p.above(p.atr(14), p.quantile(p.atr(14), 0.75, 252, 20))),
    low_volatility_flag=lambda p: p.flag(p.above(p.quantile(p.atr(14), 0.25, 252, 20), p.atr(14))),
)


def log_ratio(p, a, b):
    return p.ln(a / (b + EPS))


def rogers_satchell(p):
    return p.keep(log_ratio(p, p.H, p.C) * log_ratio(p, p.H, p.O) + log_ratio(p, p.L, p.C) * log_ratio(p, p.L, p.O))


def garman_klass(p):
    hl, co = p.keep(log_ratio(p, p.H, p.L)), p.keep(log_ratio(p, p.C, p.O))
    return p.sqrt(p.greatest(0.5 * (hl * hl) - (2 * math.log(2) - 1) * (co * co), 0.0))


def yang_zhang(p):
    overnight = p.var(log_ratio(p, p.O, p.lag(p.C)), 20)
    daily = p.var(log_ratio(p, p.C, p.O), 20)
    return p.sqrt(p.greatest(overnight + 0.34 * daily + (1 - 0.34) * p.avg(rogers_satchell(p), 20), 0.0))


def size_of_move(p):
    return p.keep(p.abs(p.roc(1)))


V3.block(
    "4.2 range estimators",
    parkinson_volatility=lambda p: p.sqrt(1 / (4 * math.log(2)) * p.keep(log_ratio(p, p.H, p.L)).squared()) / p.C,
    garman_klass_volatility=garman_klass,
    rogers_satchell_volatility=lambda p: p.sqrt(p.greatest(rogers_satchell(p), 0.0)),
    yang_zhang_volatility=yang_zhang,
    volatility_clustering=lambda p: p.pcorr20(size_of_move(p), p.lag(size_of_move(p))),
)


def realized(w):
    return lambda p: p.sqrt(p.sum(p.roc(1) * p.roc(1), w) * 252.0 / float(w))


def regime_change(p):
    rank = p.keep(p.fill(p.prank(p.atr(14), 252, 20), 0.5))
    return p.flag(p.abs(p.diff(rank, 10)) > 0.2)


V3.block(
    "4.3 realized volatility",
    realized_volatility_5d=realized(5),
    realized_volatility_20d=realized(20),
    volatility_regime_change=regime_change,
)
V3.block(
    "5.1 trend strength",
    adx14=lambda p: p.base("k_adx14"),
    adx20=lambda p: p.base("k_adx20"),
    adx50=lambda p: p.base("k_adx50"),
    trend_strength_20d=lambda p: p.unit(p.avg(p.f("adx14"), 20)),
    trend_strength_50d=lambda p: p.unit(p.avg(p.f("adx14"), 50)),
)


def averages(p):
    return [p.avg(p.C, w) for w in (20, 50, 200)]


def emas(p):
    return [p.base(f"k_ema{w}") for w in (20, 50, 200)]


def ordered(p, xs, up):
    a, b, c = xs
    return (p.above(a, b) & p.above(b, c)) if up else (p.above(b, a) & p.above(c, b))


V3.block(
    "5.2 average alignment",
    ema_alignment=lambda p: p.iff(ordered(p, emas(p), False), -1.0, p.iff(ordered(p, emas(p), True), 1.0, 0.0)),
    ma_crossover_bullish=lambda p: p.flag(ordered(p, averages(p), True)),
    ma_crossover_bearish=lambda p: p.flag(ordered(p, averages(p), False)),
    price_vs_all_mas=lambda p: p.unit(sum((p.flag(p.above(p.C, m)) for m in averages(p) + emas(p)), p.term(0.0)) / 6.0),
    sma_slope_20d=lambda p: p.diff(p.avg(p.C, 20), 10) / p.C,
    sma_slope_50d=lambda p: p.diff(p.avg(p.C, 50), 10) / p.C,
)
V3.block(
    "5.3 ema slopes",
    ema_slope_20d=lambda p: p.diff(p.base("k_ema20"), 5) / p.C,
    ema_slope_50d=lambda p: p.diff(p.base("k_ema50"), 10) / p.C,
)


def side(p):
    return p.keep(p.flag(p.above(p.C, p.avg(p.C, 50))))


def same_side(p):
    above = p.avg(side(p), 20, prev=True)
    return p.unit(p.iff(p.rn > 20, p.iff(side(p).equals(1), above, 1.0 - above), None))


def side_run(p):
    return p.unit(p.run_length(side(p).differs(p.lag(side(p))), 50) / 50.0)


def crossed_average(p):
    gap = p.keep(p.C - p.avg(p.C, 50))
    product = p.keep(gap * p.lag(gap, 5))
    return p.iff(product < 0, product, 0.0) / p.C


V3.block(
    "5.4 trend quality",
    trend_consistency=same_side,
    trend_duration=side_run,
    trend_reversal_signal=crossed_average,
    trend_acceleration=lambda p: p.diff(p.f("sma_slope_50d"), 5),
    trend_divergence=lambda p: p.pcorr20(p.roc(1), p.pct(p.avg(p.C, 50), 1), whole=True),
    trend_pullback_strength=lambda p: p.iff(p.C < p.avg(p.C, 50), (p.avg(p.C, 50) - p.C) / p.avg(p.C, 50), 0.0),
    trend_breakout_strength=lambda p: (p.C - p.avg(p.C, 50)) / p.avg(p.C, 50),
    trend_following_strength=lambda p: p.pcorr20(p.roc(5), p.pct(p.avg(p.C, 50), 5)),
    trend_regime=lambda p: 0.4 * p.f("adx14") + 0.3 * p.f("ema_alignment") + 0.3 * ((p.f("price_vs_all_mas") - 0.5) * 2.0),
)
V3.block(
    "6.1 levels",
    **{f"resistance_level_{w}d": (lambda p, w=w: p.max(p.H, w) / p.C) for w in (20, 50, 100)},
    **{f"support_level_{w}d": (lambda p, w=w: p.min(p.L, w) / p.C) for w in (20, 50, 100)},
)


def nearest(p, kind):
    away = [p.f(f"{kind}_level_{w}d") * p.C for w in (20, 50, 100)]
    return p.least(*((x - p.C) / p.C if kind == "resistance" else (p.C - x) / p.C for x in away))


def near(name):
    return lambda p: p.flag((p.f(name) >= 0) & (p.f(name) <= 0.02))


V3.block(
    "6.2 distance to levels",
    distance_to_resistance=lambda p: nearest(p, "resistance"),
    distance_to_support=lambda p: nearest(p, "support"),
    price_near_resistance=near("distance_to_resistance"),
    price_near_support=near("distance_to_support"),
)


def touches(p, x, extreme):
    hits = [p.sum(p.flag(p.abs(x / extreme(x, w) - 1.0) <= 0.01), 20, prev=True) for w in (20, 50, 100)]
    return p.unit(p.iff(p.rn > 20, p.greatest(*hits) / 20.0, None))


V3.block(
    "6.3 level strength",
    resistance_touches=lambda p: touches(p, p.H, p.max),
    support_touches=lambda p: touches(p, p.L, p.min),
    support_resistance_strength=lambda p: p.unit((p.f("resistance_touches") + p.f("support_touches")) / 2.0),
    donchian_position=lambda p: p.unit(position(p, p.C, p.min(p.L, 20), p.max(p.H, 20))),
)


def pivot(p):
    return (p.lag(p.H) + p.lag(p.L) + p.lag(p.C)) / 3.0


def fibonacci(p):
    hi, lo = p.max(p.H, 20), p.min(p.L, 20)
    mid, width = p.keep((hi + lo) / 2.0), p.keep(hi - lo)
    return p.unit(p.iff(p.C < mid, (p.C - lo) / width, p.iff(p.C > mid, (hi - p.C) / width, 0.5)))


V3.block(
    "6.4 pivots",
    pivot_point=lambda p: pivot(p) / p.C,
    pivot_resistance_1=lambda p: (2.0 * pivot(p) - p.lag(p.L)) / p.C,
    pivot_support_1=lambda p: (2.0 * pivot(p) - p.lag(p.H)) / p.C,
    fibonacci_retracement=fibonacci,
)


def traded(p):
    """Prices and volumes of the previous 20 rows as an array of structs."""
    pair = p.keep(p.join(p.syntax.pair(p.tp().sql, "vol"), p.tp(), p.V))
    return p.values(pair, -20, -1)


def volume_price(p, share):
    arr = traded(p)
    ranked = p.keep(p.join(p.syntax.sorted(arr.sql), arr))
    return p.iff(p.rn > 20, p.join(p.syntax.volume_level(ranked.sql, share), ranked), None) / p.C


def from_price(name):
    return lambda p: (p.C - p.f(name) * p.C) / p.C


V3.block(
    "7.1 volume profile",
    volume_profile_poc=lambda p: p.sum((p.H + p.L + p.C) / 3.0 * p.V, 20) / p.sum(p.V, 20) / p.C,
    volume_profile_vah=lambda p: volume_price(p, 0.7),
    volume_profile_val=lambda p: volume_price(p, 0.3),
    price_vs_poc=from_price("volume_profile_poc"),
    price_vs_vah=from_price("volume_profile_vah"),
    price_vs_val=from_price("volume_profile_val"),
)


def vwap(p):
    return p.keep(p.f("volume_weighted_price") * p.C)


V3.block(
    "7.2 vwap",
    volume_weighted_price=lambda p: p.sum(p.C * p.V, 20) / p.sum(p.V, 20) / p.C,
    price_vs_vwap=from_price("volume_weighted_price"),
    vwap_slope=lambda p: p.diff(vwap(p), 5) / p.C,
    vwap_distance_pct=lambda p: (p.C - vwap(p)) / (vwap(p) + EPS) * 100.0,
    volume_profile_width=lambda p: (p.f("volume_profile_vah") * p.C - p.f("volume_profile_val") * p.C) / p.C,
)


def volume_spread(p):
    """1 - volume-weighted deviation of the previous 20 typical prices / their mean."""
    arr, total = traded(p), p.sum(p.V, 20, prev=True)
    centre = p.keep(p.sum(p.tp() * p.V, 20, prev=True) / total)
    square = p.syntax.fold(arr.sql, "0e0", f"acc + v.v * (v.p - {centre.sql}) * (v.p - {centre.sql})")
    sd = p.sqrt(p.join(square, arr, centre) / total)
    return p.unit(p.iff(p.rn > 20, 1.0 - sd / (p.avg(p.tp(), 20) + EPS), None))


def volume_breakout(p):
    return p.flag((p.V > 1.5 * p.avg(p.V, 20)) & (p.C > p.lag(p.max(p.H, 20))))


def volume_here(p):
    arr = traded(p)
    near_price = p.join(p.syntax.near_volume(arr.sql, "c"), arr, p.C)
    return p.unit(p.iff(p.rn > 20, near_price / (p.sum(p.V, 20) + EPS), None))


V3.block(
    "7.3 volume analysis",
    volume_distribution=volume_spread,
    volume_climax=lambda p: p.flag(p.V > 2.0 * p.avg(p.V, 20)),
    volume_dry_up=lambda p: p.flag(p.V < 0.5 * p.avg(p.V, 20)),
    volume_breakout=volume_breakout,
    volume_divergence=lambda p: p.pcorr20(p.roc(1), p.pct(p.V, 1)),
    volume_autocorrelation=lambda p: p.pcorr20(p.V, p.lag(p.V), whole=True),
    volume_imbalance=lambda p: (p.C - p.O) / (p.H - p.L) * p.V / (p.avg(p.V, 20) + EPS),
    volume_directional_force=lambda p: p.fill(((p.C - p.L) - (p.H - p.C)) / (p.H - p.L), 0.0) * p.V / (p.avg(p.V, 20) + EPS),
    volume_at_price=volume_here,
    volatility_ratio=lambda p: p.std(p.roc(1), 5) / (p.std(p.roc(1), 21) + EPS),
)
