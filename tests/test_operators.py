"""Labels, trades, reports, cleaning and lists against plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dailybars.operators import clean, filters, incremental, labels, quality, reports, scoring, stops, trades
from dailybars.plans.ordered import exact_quantiles, with_totals
from dailybars.sources import tables


def bars_of(spark, close, high=None, ticker="A"):
    days = pd.bdate_range("2020-01-01", periods=len(close)).date
    pdf = pd.DataFrame({"ticker": ticker, "date": days, "open": np.array(close, float), "high": np.array(high or close, float),
                        "low": np.array(close, float), "close": np.array(close, float), "volume": 1})
    return spark.createDataFrame(pdf)


LABEL_CASES = [
    ([100, 105, 110, 115, 120, 115, 110, 105, 100, 95], [100, 108, 112, 118, 120, 117, 112, 107, 102, 98], 5, 0.15, {0: 1, 1: 0, 2: 0}),
    ([100, 110, 120, 130, 140], None, 5, 0.10, {4: 0}),
    ([100] * 6, [100, 100, 115, 100, 100, 100], 3, 0.15, {0: 0}),
    ([100] * 3, [100, 150, 100], 2, 0.5, {0: 0}),
]


@pytest.mark.parametrize("close,high,h,t,want", LABEL_CASES)
def test_label_cases(spark, close, high, h, t, want):
    got = [r["y"] for r in labels.label_future_return(bars_of(spark, close, high), h, t, "y").orderBy("date").collect()]
    assert {i: got[i] for i in want} == want


def test_labels_do_not_cross_tickers_or_blocks(spark):
    both = bars_of(spark, [100] * 9).unionByName(bars_of(spark, [100] * 5 + [200] * 4, ticker="B"))
    for size in (2, 100):
        got = labels.label_future_return(both, 3, 0.5, "y", size).groupBy("ticker").agg(F.sum("y").alias("n")).collect()
        assert {r["ticker"]: r["n"] for r in got} == {"A": 0, "B": 3}


def simulate(g, signal, h, target, stop):
    """Row-by-row oracle of the trade rules."""
    out, busy_until = [], None
    rows = g.reset_index(drop=True)
    for i, r in rows.iterrows():
        if not signal[i] or (busy_until is not None and r.date <= busy_until):
            continue
        entry, floor = r.open, r.open * (1 - stop)
        found = None
        for k in range(1, h + 1):
            if i + k >= len(rows):
                last = rows.iloc[-1]
                found = (last.date, last.close, "end_of_data")
                break
            d = rows.iloc[i + k]
            if d.open < floor:
                found = (d.date, d.open, "stop_loss")
            elif d.low < floor or d.close < floor:
                found = (d.date, floor, "stop_loss")
            elif k == h:
                found = (d.date, d.open, "target_reached" if d.open / entry - 1 >= target else "time_limit")
            elif d.close / entry - 1 >= target:
                found = (d.date, d.close, "target_reached")
            if found:
                break
        busy_until = found[0]
        out.append((r.ticker, r.date, entry, *found))
    return out


@pytest.mark.parametrize("size", [7, 50, 8192])
def test_trades_equal_a_loop(walk, size):
    pdf, bars, _, _ = walk
    marked = bars.withColumn("go", F.pmod(F.dayofyear("date") * 7, F.lit(5)) < 2)
    got = trades.backtest(marked, "go", 6, 1000.0, 0.04, stops.StopConfig("constant", 0.03), size=size)
    got = sorted((r.ticker, r.entry_date, r.entry_price, r.exit_date, r.exit_price, r.exit_reason) for r in got.collect())
    want = []
    for _, g in pdf.groupby("ticker"):
        go = [(d.timetuple().tm_yday * 7) % 5 < 2 for d in g.date]
        want += simulate(g, go, 6, 0.04, 0.03)
    assert len(got) == len(want) > 50
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and a[3] == b[3] and a[5] == b[5]
        np.testing.assert_allclose([a[2], a[4]], [b[2], b[4]])


def test_entry_lag_uses_the_next_open(walk):
    pdf, bars, _, _ = walk
    marked = bars.withColumn("go", F.dayofmonth("date") == 5)
    got = trades.candidate_exits(marked, "go", 3, entry_lag=1, size=60).select("ticker", "entry_date", "entry_price").collect()
    g = pdf[pdf.ticker == "AAA"].reset_index(drop=True)
    want = {g.date[i + 1]: g.open[i + 1] for i in range(len(g) - 1) if g.date[i].day == 5}
    assert {r.entry_date: r.entry_price for r in got if r.ticker == "AAA"} == want


def make_trades(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2021-01-01")
    entry = [start + pd.Timedelta(days=int(d)) for d in rng.integers(0, 60, n)]
    hold = rng.integers(0, 9, n)
    r = rng.normal(0.002, 0.05, n)
    pdf = pd.DataFrame({"ticker": [f"T{i:04d}" for i in range(n)], "entry_date": [e.date() for e in entry],
                        "exit_date": [(e + pd.Timedelta(days=int(h))).date() for e, h in zip(entry, hold)],
                        "return": r, "pnl": r * 1000, "holding_days": hold.astype("int32"),
                        "exit_reason": np.where(r < -0.04, "stop_loss", "time_limit")})
    return pdf, spark.createDataFrame(pdf)


def test_metrics_equal_a_loop(spark):
    pdf, df = make_trades(spark)
    m = reports.trade_metrics(df).first()
    ordered = pdf.sort_values(["exit_date", "ticker", "entry_date"])
    equity = ordered.pnl.cumsum()
    events = sorted([(t.entry_date, t.ticker, 0, 1) for t in pdf.itertuples()] + [(t.exit_date, t.ticker, 1, -1) for t in pdf.itertuples()])
    most = max(np.cumsum([e[3] for e in events]))
    assert m.n_trades == 400 and m.max_concurrent_positions == most
    np.testing.assert_allclose(m.max_drawdown, (equity.cummax() - equity).max())
    np.testing.assert_allclose(m.sharpe_ratio, pdf["return"].mean() / pdf["return"].std() * np.sqrt(252 / pdf.holding_days.mean()))
    np.testing.assert_allclose(m.profit_factor, pdf.pnl[pdf.pnl > 0].sum() / -pdf.pnl[pdf.pnl < 0].sum())


def test_running_totals_over_segments(spark):
    pdf, df = make_trades(spark, 300, 4)
    got = with_totals(df, ["exit_date", "ticker"], sums=[("e", "pnl")], highs=[("top", "e")]).toPandas().sort_values("pos")
    want = pdf.sort_values(["exit_date", "ticker"]).pnl.cumsum()
    assert got.pos.tolist() == list(range(1, 301))
    np.testing.assert_allclose(got.e, want)
    np.testing.assert_allclose(got.top, want.cummax())


def test_exact_quantiles(spark):
    pdf, df = make_trades(spark, 251, 2)
    row = exact_quantiles(df, "return", {"a": 0.5, "b": 0.01, "c": 0.99}, unique=("ticker",)).first()
    np.testing.assert_allclose([row.a, row.b, row.c], pdf["return"].quantile([0.5, 0.01, 0.99]))


def test_rolling_metrics_on_small_blocks(spark):
    pdf, df = make_trades(spark, 200, 6)
    got = reports.rolling_trade_metrics(df, 20, size=30).toPandas().sort_values(["exit_date", "ticker"])
    r = pdf.sort_values(["exit_date", "ticker"])["return"]
    want = (r.rolling(20, min_periods=1).mean() / r.rolling(20, min_periods=1).std() * np.sqrt(252)).fillna(0)
    np.testing.assert_allclose(got.rolling_sharpe, want)


def test_profit_factor_without_losses_is_null(spark):
    _, df = make_trades(spark)
    assert reports.trade_metrics(df.where("pnl > 0")).first().profit_factor is None


def test_stop_modes(spark):
    rows = [(0.03, 95.0, 100.0), (None, 95.0, 100.0), (0.03, None, 100.0), (0.03, 101.0, 100.0), (0.001, 99.9, 100.0)]
    df = spark.createDataFrame(rows, "atr14_normalized double, swing_low_10d double, open double")
    swing = [r[0] for r in df.withColumns(stops.stop_columns(stops.StopConfig("swing_atr"), df.columns)).select("stop_loss_pct").collect()]
    np.testing.assert_allclose(swing, [0.0725, 0.05, 0.054, 0.054, 0.04])
    atr = [r[0] for r in df.withColumns(stops.stop_columns(stops.StopConfig("adaptive_atr"), df.columns)).select("stop_loss_pct").collect()]
    np.testing.assert_allclose(atr, [0.054, 0.04, 0.054, 0.054, 0.04])
    assert stops.stop_config(return_threshold=0.2).constant_stop_loss_pct == 0.1 and stops.stop_config().constant_stop_loss_pct == 0.075


def test_null_fails_a_filter_and_absent_features_are_skipped(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, -1.0)], "id int, x double")
    kept = filters.apply_entry_filters(df, [("x", ">", 0.0), ("missing", "<", 1.0), ("x", "??", 1.0)])
    assert [r.id for r in kept.collect()] == [1]


def test_clean_bars(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "XYZ.csv").write_text(
        "Date,Open,HIGH,Low,Close,Volume\n2020-01-02,1,2,1,2,10\n2020-01-02,1,2,1,2,10\nbad,1,2,1,2,10\n2020-01-03,-1,2,1,2,10\n"
        "2020-01-06,1,2,1,2,\n2020-01-07,x,2,1,2,5\n2020-01-20,1,2,1,2,inf\n2020-01-21,3,4,3,4,7\n")
    raw = tables.read_raw(spark, str(tmp_path / "raw"))
    got = clean.clean_bars(raw).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.volume) for r in got] == [("XYZ", "2020-01-02", 10), ("XYZ", "2020-01-21", 7)]
    s = clean.cleaning_statistics(raw).first()
    assert (s.rows_before, s.rows_after, s.volume_replaced, s.rows_dropped) == (8, 2, 2, 6)
    assert clean.find_gaps(clean.clean_bars(raw)).first()["days"] == 19
    with pytest.raises(ValueError):
        clean.normalise_headers(raw.drop("volume"))


def test_split_adjustment_over_blocks(spark):
    df = bars_of(spark, [10.0] * 9).withColumn("split_coefficient", F.when(F.dayofmonth("date").isin(3, 8), 2.0).otherwise(1.0))
    for size in (2, 100):
        got = [r.close for r in clean.split_adjust(df, size).orderBy("date").collect()]
        assert got == [10.0, 10.0, 20.0, 20.0, 20.0, 40.0, 40.0, 40.0, 40.0]


def test_append_keeps_stored_rows(spark):
    old, new = bars_of(spark, [1.0, 2.0]), bars_of(spark, [9.0, 9.0, 3.0]).unionByName(bars_of(spark, [5.0], ticker="B"))
    got = sorted((r.ticker, r.close) for r in clean.append_new(old, new).collect())
    assert got == [("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 5.0)]


def test_incremental_equals_full(walk):
    from dailybars.features.build import build_features
    _, bars, _, _ = walk
    build = lambda b, names: build_features(b, names)
    names = ["sma20_ratio", "rsi14", "ema20_ratio"]
    full = build(bars, names)
    stored = full.drop("ema20_ratio").where("date < '2020-01-01'")
    got = incremental.merge_features(bars, stored, names, build).select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"])
    want = full.toPandas().sort_values(["ticker", "date"])[got.columns]
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), rtol=1e-9)


def test_asof_takes_the_last_row_before(spark):
    from dailybars.plans.asof import asof_by_ticker
    right = bars_of(spark, list(range(1, 30))).where("dayofmonth(date) in (1, 9, 30)").select("ticker", "date", "close")
    left = spark.createDataFrame(pd.DataFrame({"ticker": "A", "entry_date": pd.to_datetime(["2019-12-31", "2020-01-09", "2020-01-29", "2020-05-05"]).date}))
    got = {str(r.entry_date): str(r.date) for r in asof_by_ticker(left, right, "entry_date").collect()}
    assert got == {"2020-01-09": "2020-01-09", "2020-01-29": "2020-01-09", "2020-05-05": "2020-01-30"}


def test_correlations_skip_nulls_by_pair(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[:, 1] += x[:, 0]
    x[rng.random((300, 3)) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc"))
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abc"]).repartition(5)
    want = pdf.corr()
    for r in quality.correlations(df, list("abc")).collect():
        np.testing.assert_allclose(r["corr"], want.loc[r.feature_1, r.feature_2])


def test_importance_lists(spark):
    imp = spark.createDataFrame([("a", 0.05), ("b", 0.005), ("c", 0.0005), ("d", 0.00005), ("e", 0.0)], "feature string, importance double")
    tiers = {r.tier: r.features for r in quality.importance_tiers(imp).collect()}
    assert tiers == {"high": 1, "medium": 1, "low": 1, "very_low": 1, "zero": 1}
    disabled = lambda *a: sorted(r.feature for r in quality.features_to_disable(imp, *a).collect())
    assert disabled("drop_zero") == ["e"] and disabled("keep_top_n", 2) == ["c", "d", "e"] and disabled("drop_below_threshold", 0.001) == ["c", "d", "e"]


def test_evaluation_against_definitions(spark):
    rng = np.random.default_rng(9)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    m = scoring.evaluate(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])
    np.testing.assert_allclose(m.roc_auc, want)
    assert m.tp + m.fp + m.fn + m.tn == 200


def test_sources_round_trip(spark, walk, tmp_path):
    _, bars, _, _ = walk
    tables.write_clean(bars, f"{tmp_path}/clean")
    assert tables.read_clean(spark, f"{tmp_path}/clean").count() == bars.count()
    tables.write_trades(tables.empty_trades(spark), f"{tmp_path}/trades")
    assert tables.read_trades(spark, f"{tmp_path}/trades").count() == 0
    tables.write_features(bars, f"{tmp_path}/f")
    assert dict(tables.read_features(spark, f"{tmp_path}/f").dtypes)["close"] == "float"
    assert tables.pending(bars, bars.where("ticker = 'AAA'")).select("ticker").distinct().count() == 2


def test_windows_share_one_exchange(walk):
    """All window stages of a sheet run behind a single shuffle and sort of the blocks."""
    from dailybars.features.build import new_sheet
    from dailybars.features.v3_price import V3
    from dailybars.plans.blocks import number_rows
    from dailybars.plans.sheets import run_sheet
    from dailybars.features.build import price_columns
    from dailybars.plans.cut import written
    sheet = new_sheet(V3)
    outputs = {n: sheet.f(n) for n in ("momentum_rank", "bb_squeeze", "rs_rank_20d", "trend_duration") if n != "rs_rank_20d"}
    base = written(number_rows(price_columns(walk[1])), "base")
    plan = run_sheet(base, sheet, outputs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") >= 2 and plan.count("Sort [") == 1


def test_first_exit_equals_a_walk():
    rng = np.random.default_rng(3)
    low, high = rng.normal(0, 1, 300), rng.normal(0, 1, 300)
    low[rng.random(300) < 0.1] = np.nan
    start = rng.integers(0, 300, 200)
    for reach in (1, 2, 7, 64, 100):
        end = np.minimum(start + rng.integers(0, reach + 1, 200), 300)
        floor, top = rng.normal(-2, 0.5, 200), rng.normal(2, 0.5, 200)
        floor[:20] = np.nan
        got = trades.FirstExit(low, high, reach).find(start, end, lambda lo, hi, i: (lo < floor[i]) | (hi >= top[i]))
        want = [next((j for j in range(a, b) if low[j] < f or high[j] >= t), b) for a, b, f, t in zip(start, end, floor, top)]
        assert got.tolist() == want
