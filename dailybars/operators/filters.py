"""Entry filters: (feature, operator, threshold) triples folded into one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The default filter preset.
DEFAULT_FILTERS = [
    ("rsi_slope", ">", -1.349),
    ("log_return_1d", ">", -0.017),
    ("log_return_5d", ">", -0.057),
    ("relative_strength_spy_5d", ">", -4.269),
    ("market_correlation_20d", ">", 0.532),
    ("candle_body_pct", ">", -25.370),
    ("close_position_in_range", ">", 0.368),
    ("price_near_support", "<", 0.443),
    ("rolling_min_5d_breakdown", "<", 1.481),
    ("close_vs_ma10", ">", 0.954),
    ("weekly_rsi_14w", "<", 44.455),
    ("trend_consistency", "<", 35.638),
    ("high_vs_close", "<", 3.000),
    ("macd_cross_signal", ">", -0.074),
    ("month_of_year_cos", ">", 0.172),
    ("day_of_month_cos", ">", 0.039),
]

# The preset recommended for the candidate list.
RECOMMENDED_FILTERS = [
    ("candle_body_pct", ">", -10.0),
    ("close_position_in_range", ">", 0.40),
    ("weekly_rsi_14w", "<", 42.0),
    ("market_correlation_20d", ">", 0.60),
    ("volatility_regime", ">", 60.0),
]

COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


def usable(columns, filters):
    """Filters on absent features or with unknown operators are left out."""
    have = set(columns)
    return [f for f in filters if f[0] in have and f[1] in COMPARE]


def passes(triple) -> Column:
    """One filter; a null feature fails."""
    feature, op, value = triple
    return F.coalesce(COMPARE[op](F.col(feature), F.lit(value)), F.lit(False))


def passes_all(columns, filters) -> Column:
    return reduce(lambda a, b: a & b, [passes(t) for t in usable(columns, filters)], F.lit(True))


def apply_entry_filters(df: DataFrame, filters) -> DataFrame:
    """Rows that pass every filter (feature tables, latest rows and trade logs alike)."""
    return df.where(passes_all(df.columns, filters))


def timing_ok(date="date", avoid_monday_tuesday=True, avoid_october=True) -> Column:
    ok = F.lit(True)
    if avoid_monday_tuesday:
        ok = ok & (F.weekday(date) >= 2)
    if avoid_october:
        ok = ok & (F.month(date) != 10)
    return ok


def date_slice(df: DataFrame, start=None, end=None, date="date") -> DataFrame:
    """start <= date <= end, either side open."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def filter_trades(trades: DataFrame, start=None, end=None, low=None, high=None, ticker=None) -> DataFrame:
    """Trade log by entry date range, return range and ticker substring."""
    trades = date_slice(trades, start, end, "entry_date")
    if low is not None:
        trades = trades.where(F.col("return") >= low)
    if high is not None:
        trades = trades.where(F.col("return") <= high)
    if ticker:
        trades = trades.where(F.upper("ticker").contains(ticker.strip().upper()))
    return trades
