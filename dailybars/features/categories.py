"""What kind of indicator each block of the v3 set holds."""

from __future__ import annotations

from dailybars.features import v3_composite, v3_periods  # noqa: F401  (fill the registry)
from dailybars.features.v3_price import V3

BLOCKS = {
    "price_action": ["1.1 price", "1.2 returns", "1.3 yearly range", "8.1 weekly returns", "8.4 weekly comparisons", "11 price action", "24 channels"],
    "trend": ["1.4 averages", "1.5 average slopes", "5.1 trend strength", "5.2 average alignment", "5.3 ema slopes", "5.4 trend quality",
              "8.2 weekly averages", "9 monthly", "25 exhaustion"],
    "momentum": ["2.2 rsi", "2.3 macd", "2.4 rate of change", "2.5 stochastic", "2.6 oscillators", "3.1 momentum oscillators", "3.2 momentum quality",
                 "3.3 momentum variants", "8.3 weekly indicators", "18 technical"],
    "volatility": ["1.6 volatility", "4.1 volatility regime", "4.2 range estimators", "4.3 realized volatility", "17 volatility structure",
                   "26.1 forecast", "26.4 ranks", "26.5 volatility and volume", "26.6 return and volatility"],
    "volume": ["2.1 volume", "7.1 volume profile", "7.2 vwap", "7.3 volume analysis", "19 microstructure"],
    "pattern": ["10.1 candle parts", "10.2 reversal patterns", "10.3 continuation patterns", "10.4 single candles", "10.5 pattern quality",
                "6.1 levels", "6.2 distance to levels", "6.3 level strength", "6.4 pivots", "26.3 distance rank"],
    "market": ["12 market regime", "13 market direction", "14 relative strength", "23 market context"],
    "statistics": ["16 statistics"],
    "calendar": ["15 calendar"],
    "signal": ["20 interactions", "21 gain", "22 signals", "26.2 gain trend", "26.7 regime turns", "26.8 ensembles", "27 precision", "28 precision 2"],
}
CATEGORY = {name: category for category, blocks in BLOCKS.items() for block in blocks for name in V3.blocks[block]}
