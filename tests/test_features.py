"""Features against pandas and against themselves on small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dailybars.features.build import build_features
from dailybars.features.v1_v2 import V1, V2
from dailybars.features.v3_price import V3
from dailybars.plans.blocks import into_blocks, number_rows

SOME = ["sma20_ratio", "rsi14", "volatility_21d", "atr14_normalized", "roc10", "ytd_return", "trend_duration", "trend_residual",
        "momentum_rank", "momentum_divergence", "price_skewness_20d", "price_kurtosis_20d", "high_volatility_flag", "ema20_ratio",
        "obv_momentum", "adx14", "volume_profile_vah", "relative_strength_spy", "weekly_sma_5w", "monthly_sma_3m", "consecutive_green_days",
        "aroon_up", "hurst_exponent", "volatility_regime_transition_probability", "gain_regime_transition_probability"]


@pytest.fixture(scope="module")
def built(walk):
    _, bars, _, market = walk
    return build_features(bars, SOME, market=market).toPandas().sort_values(["ticker", "date"], ignore_index=True)


def per_ticker(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker", sort=True)], ignore_index=True)


def same(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got[~np.isnan(got)], want[~np.isnan(want)], rtol=tol, atol=tol)


def rsi(c, p):
    d = c.diff()
    gain = d.clip(lower=0).rolling(p, min_periods=1).mean()
    loss = (-d.clip(upper=0)).rolling(p, min_periods=1).mean().replace(0, 1e-10)
    return (100 - 100 / (1 + gain / loss) - 50) / 50


PANDAS = {
    "sma20_ratio": lambda g: g.close / g.close.rolling(20, min_periods=1).mean(),
    "rsi14": lambda g: rsi(g.close, 14),
    "volatility_21d": lambda g: g.close.pct_change().rolling(21, min_periods=1).std(),
    "roc10": lambda g: g.close.pct_change(10),
    "momentum_rank": lambda g: g.close.pct_change(10).rolling(252, min_periods=20).rank(pct=True).fillna(0.5),
    "price_skewness_20d": lambda g: g.close.rolling(20, min_periods=10).skew().fillna(0),
    "price_kurtosis_20d": lambda g: g.close.rolling(20, min_periods=10).kurt().fillna(0),
    "ema20_ratio": lambda g: g.close / g.close.ewm(span=20, adjust=False).mean(),
    "ytd_return": lambda g: g.close / g.close.groupby(pd.to_datetime(g.date).dt.year).transform("first") - 1,
}


@pytest.mark.parametrize("name", sorted(PANDAS))
def test_feature_equals_pandas(walk, built, name):
    same(built[name], per_ticker(walk[0], PANDAS[name]), 1e-6 if "osis" in name or "skew" in name else 1e-9)


def test_market_is_aligned_as_of_the_date(walk, built):
    pdf, _, market, _ = walk
    m = market.assign(date=pd.to_datetime(market.date)).set_index("date").close

    def strength(g):
        aligned = m.reindex(pd.to_datetime(g.date), method="ffill").reset_index(drop=True)
        return g.close.pct_change(20) - aligned.pct_change(20, fill_method=None)
    same(built["relative_strength_spy"], per_ticker(pdf, strength))


def test_weekly_series_is_visible_from_its_friday(walk, built):
    def weekly(g):
        c = g.set_index(pd.to_datetime(g.date)).close
        w = c.resample("W-FRI").last().rolling(5, min_periods=1).mean()
        return (w.reindex(c.index, method="ffill") / c).reset_index(drop=True)
    same(built["weekly_sma_5w"], per_ticker(walk[0], weekly))


def test_small_blocks_change_nothing(walk, built):
    _, bars, _, market = walk
    small = build_features(bars, SOME, market=market, size=64).toPandas().sort_values(["ticker", "date"], ignore_index=True)
    for name in SOME:
        same(small[name], built[name], 1e-7)


def test_anchored_run_equals_loop(spark):
    from dailybars.plans.runs import add_anchored_runs, add_jump_runs
    rng = np.random.default_rng(3)
    g = np.clip(np.cumsum(rng.normal(0, 0.05, 900)) % 1.0, 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "rn": np.arange(1, 901), "n_rows": 900, "g": g}))
    for size in (7, 100, 5000):
        got = add_anchored_runs(df, "g", 0.2, "run", size).orderBy("rn").toPandas()["run"]
        jumps = add_jump_runs(df, "g", 0.1, "run", size).orderBy("rn").toPandas()["run"]
        want, jump, anchor, n, k = [], [], None, 0, 0
        for i, v in enumerate(g):
            anchor, n = (v, 1) if anchor is None or abs(v - anchor) > 0.2 else (anchor, n + 1)
            k = 1 if i == 0 or abs(v - g[i - 1]) > 0.1 else k + 1
            want.append(n)
            jump.append(k)
        assert got.tolist() == want and jumps.tolist() == jump


def test_numbering_counts_within_ticker(walk):
    pdf, bars, _, _ = walk
    got = number_rows(bars).toPandas().sort_values(["ticker", "date"])
    assert (got.rn.to_numpy() == got.groupby("ticker").cumcount().to_numpy() + 1).all()
    assert (got.n_rows.to_numpy() == got.groupby("ticker").ticker.transform("size").to_numpy()).all()


def test_blocks_hold_each_row_once_and_its_neighbours(walk):
    got = into_blocks(number_rows(walk[1]), 10, 3, 50).toPandas()
    assert got.own.sum() == len(walk[0])
    block = got[(got.ticker == "AAA") & (got.blk == 2)].rn
    assert block.min() == 101 - 10 and block.max() == 150 + 3


def test_registered_counts():
    assert len(V3) == 410
    assert len(set(V1) - {"log_return_1d", "log_return_5d"}) == 61 and set(V1) == set(V2)


def test_no_infinities_and_same_columns_for_all_tickers(walk):
    _, bars, _, market = walk
    names = [n for b in ("1.3 yearly range", "2.6 oscillators", "6.4 pivots", "10.1 candle parts", "19 microstructure") for n in V3.blocks[b]]
    out = build_features(bars, names, market=market)
    bad = out.agg(*[F.sum((F.isnan(n) | (F.abs(n) == float("inf"))).cast("int")).alias(n) for n in names]).first().asDict()
    assert not any(bad.values()) and out.count() == len(walk[0])


def test_without_market_features_are_constants(walk):
    out = build_features(walk[1], ["market_regime", "market_breadth", "relative_strength_spy", "beta_spy_252d"]).distinct()
    row = out.select("market_regime", "market_breadth", "relative_strength_spy", "beta_spy_252d").distinct().collect()
    assert [tuple(r) for r in row] == [(2.0, 0.5, 0.0, None)]


def test_adjusted_close_is_preferred(walk):
    out = build_features(walk[1].withColumn("adj_close", F.col("close") / 2), ["price", "bid_ask_spread_proxy"])
    row = out.join(walk[1], ["ticker", "date"]).where("price <> close / 2").count()
    assert row == 0


def test_a_failing_feature_becomes_null(walk, monkeypatch):
    monkeypatch.setitem(V3, "broken", lambda p: p.no_such_thing)
    issues = []
    out = build_features(walk[1], ["broken", "price"], issues=issues)
    assert [n for n, _ in issues] == ["broken"] and out.where("broken is not null or price is null").count() == 0
