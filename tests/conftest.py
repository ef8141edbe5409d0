import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Three tickers of random-walk bars (one with a single row, one with date gaps) and a market with missing days."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(42)
    parts = []
    for ticker, n in (("AAA", 420), ("BBB", 300), ("ONE", 1)):
        days = pd.bdate_range("2019-01-01", periods=n)
        if ticker == "BBB":
            days = days.delete(range(40, 60))
        close = 100 * np.cumprod(1 + rng.normal(0.001, 0.02, len(days)))
        open_ = close * (1 + rng.normal(0, 0.005, len(days)))
        parts.append(pd.DataFrame({
            "ticker": ticker, "date": days.date, "open": open_, "high": np.maximum(open_, close) * 1.01,
            "low": np.minimum(open_, close) * 0.99, "close": close, "volume": rng.integers(10**6, 10**7, len(days))}))
    pdf = pd.concat(parts, ignore_index=True)
    flat = pdf["ticker"].eq("AAA") & (pdf.index % 97 == 5)  # high = low on some rows
    for c in ("open", "high", "low"):
        pdf.loc[flat, c] = pdf.loc[flat, "close"]
    days = pd.bdate_range("2018-12-01", periods=480)
    market = pd.DataFrame({"ticker": "SPY", "date": days.date, "close": 300 * np.cumprod(1 + rng.normal(0.0005, 0.01, len(days)))})
    market = market[market.index % 11 != 3]
    schema = "ticker string, date date, open double, high double, low double, close double, volume bigint"
    return pdf, spark.createDataFrame(pdf, schema), market, spark.createDataFrame(market, "ticker string, date date, close double")
