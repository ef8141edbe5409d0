"""Updating stored feature tables with new dates and new features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def new_dates(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Bars whose (ticker, date) is not stored yet."""
    return bars.join(stored.select("ticker", "date"), ["ticker", "date"], "left_anti")


def common_dates(bars: DataFrame, stored: DataFrame) -> DataFrame:
    return bars.join(stored.select("ticker", "date"), ["ticker", "date"], "left_semi")


def new_features(wanted, stored: DataFrame) -> list[str]:
    return [n for n in wanted if n not in stored.columns]


def dropped_features(wanted, stored: DataFrame) -> list[str]:
    keys = {"ticker", "date", "rn", "open", "high", "low", "close", "volume"}
    return [c for c in stored.columns if c not in keys and c not in set(wanted)]


def touched_bars(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Whole history of the tickers that have new dates.

    Windows and smoothers on new dates need the rows before them, so those
    tickers are computed again from their full history; others are left alone.
    """
    return bars.join(new_dates(bars, stored).select("ticker").distinct(), "ticker", "left_semi")


def merge_features(bars: DataFrame, stored: DataFrame, wanted, build) -> DataFrame:
    """Stored features, new columns on old dates, all columns on new dates; prices always from ``bars``.

    ``build(bars, names)`` returns ticker, date and the named features.
    """
    wanted = list(wanted)
    added = new_features(wanted, stored)
    kept = [n for n in wanted if n not in added]
    old = stored.select("ticker", "date", *kept)
    if added:
        old = old.join(build(bars, added).select("ticker", "date", *added), ["ticker", "date"], "left")
    fresh = build(touched_bars(bars, stored), wanted).select("ticker", "date", *wanted)
    fresh = fresh.join(stored.select("ticker", "date"), ["ticker", "date"], "left_anti")
    merged = old.unionByName(fresh)
    return bars.join(merged, ["ticker", "date"])
