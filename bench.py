"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The bar table is derived from the order lines and stored first, because the
feature builder starts from a stored clean bar table.  Every query is written to
the ``noop`` sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from dailybars.features.build import build_features
from dailybars.features.v1_v2 import V1
from dailybars.features.v3_price import V3
from dailybars.operators.labels import label_future_return
from dailybars.operators.quality import correlations
from dailybars.operators.reports import trade_metrics
from dailybars.operators.stops import StopConfig
from dailybars.operators.trades import run_backtest
from dailybars.sources import fixture, tables

NOT_IN_V1_REGISTRY = {"log_return_1d", "log_return_5d"}
GAIN = [n for b in ("21 gain", "26.2 gain trend") for n in V3.blocks[b]]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    seconds = {}

    def timed(name, make):
        start = time.time()
        df = make()
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)

    timed("bars_from_lines", lambda: fixture.bars(spark, sf))
    tables.write_clean(fixture.bars(spark, sf), f"{work}/bars", per_ticker=False)
    tables.write_clean(fixture.market(spark, sf), f"{work}/market", per_ticker=False)
    tables.write_clean(fixture.sector_bars(spark, sf), f"{work}/sectors", per_ticker=False)
    bars, market, sector = (tables.read_clean(spark, f"{work}/{n}") for n in ("bars", "market", "sectors"))
    sizes = bars.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers")).first()
    build = lambda names, fs="v3", **kw: build_features(bars, names, fs, market, sector, fixture.sector_map(spark), **kw)

    timed("features_v1_61", lambda: build([n for n in V1 if n not in NOT_IN_V1_REGISTRY], "v1"))
    timed("hurst_exponent", lambda: build(["hurst_exponent"], "v1"))
    timed("trend_residual", lambda: build(["trend_residual"], "v1"))
    timed("aroon_oscillator", lambda: build(["aroon_oscillator"], "v1"))
    timed("mkt_spy_sma200_slope", lambda: build(["mkt_spy_sma200_slope"], "v1"))
    timed("fractal_dimension_index", lambda: build(["fractal_dimension_index"], "v1"))
    timed("gain_features", lambda: build(GAIN))
    timed("gain_regime_transition", lambda: build(["gain_regime_transition_probability"]))
    timed("features_v3_410", lambda: build(list(V3)))

    stored = f"{work}/features"
    names = ["rsi14", "atr14_normalized", "swing_low_10d", "volatility_21d", "relative_volume", "roc10", "sma20_ratio"]
    start = time.time()
    tables.write_features(label_future_return(build(names, prices=True), 20, 0.05), stored)
    seconds["feature_table_write"] = round(time.time() - start, 3)
    features = tables.read_features(spark, stored).withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")})
    signal = F.col("rsi14") < -0.08
    trades = lambda: run_backtest(features, signal, 20, 1000.0, 0.10, StopConfig("adaptive_atr"))
    timed("backtest", trades)
    timed("backtest_metrics", lambda: trade_metrics(trades()))
    timed("correlations", lambda: correlations(features, names))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "bars": sizes["rows"], "tickers": sizes["tickers"],
        "v3_seconds_per_ticker": round(seconds["features_v3_410"] / sizes["tickers"], 3)}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
