"""One query per feature block."""

from __future__ import annotations

import re

from checks.duck_features import feature_sql
from dailybars.features.build import build_features
from dailybars.features.v1_v2 import V1, V2
from dailybars.features.v3_price import V3
from dailybars.features.windows import WINDOWS
from dailybars.sources import fixture as fx

# Features with quotients of nearly empty ranges: six decimals are too fine for their size.
WIDE = {"liquidity_measure", "market_depth_proxy", "signal_risk_reward", "gain_risk_ratio",
        "candle_wicks_ratio", "engulfing_strength", "obv_momentum"}


def rounded(df, names):
    return df.selectExpr("ticker", "date", *(f"{rounded_sql(n)} as {n}" for n in names))


def rounded_sql(name):
    """Six decimals; the nudge keeps exact ties off the rounding edge."""
    if name not in WIDE:
        return f"round({name} + 1.3e-8, 6) + 0e0"
    return (f"case when abs({name}) < 1e4 then round({name}, 4) when abs({name}) < 1e8 then round({name}, 0) "
            f"else round({name} / 1e6, 0) * 1e6 end + 0e0")


def block_query(names, feature_set):
    def run(spark, path):
        df = build_features(fx.bars(spark, path), names, feature_set, market=fx.market(spark, path),
                            sector_bars=fx.sector_bars(spark, path), sectors=fx.sector_map(spark))
        return rounded(df, names)
    return run


def key_of(feature_set, block):
    name = re.sub("[^a-z0-9]+", "_", block)
    return name if feature_set == "windows" else f"{feature_set}_{name}"


def add(queries, sqls):
    for fs, registry in (("v3", V3), ("v1", V1), ("v2", V2), ("windows", WINDOWS)):
        for block, names in registry.blocks.items():
            key = key_of(fs, block)
            queries[key] = block_query(list(names), fs)
            sqls[key] = feature_sql(list(names), fs, rounded_sql)
