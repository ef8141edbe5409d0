"""Results that must not depend on units, sizes, column order or the kind of cluster."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dailybars.features.build import V3, build_features
from dailybars.operators.reports import preset_comparison, trade_metrics
from dailybars.operators.scoring import threshold_sweep
from dailybars.plans.blocks import number_rows
from dailybars.plans.cut import shared_folder
from dailybars.plans.runs import add_direction_runs
from dailybars.sources import tables

BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def bars(spark, close):
    days = pd.date_range("2020-01-01", periods=len(close)).date
    return spark.createDataFrame([("A", d, float(c), float(c), float(c), float(c), 1) for d, c in zip(days, close)], BARS)


def test_runs_longer_than_any_block(spark):
    rows = number_rows(bars(spark, np.arange(1, 61)))
    got = [r["run"] for r in add_direction_runs(rows, "close", "run", 7).orderBy("rn").collect()]
    assert got == [1.0, *[float(i) for i in range(1, 60)]]


def test_ranks_do_not_depend_on_the_unit(spark):
    rng = np.random.default_rng(3)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, 150)), 2)
    close[40:60] = close[40]
    ranks = []
    for unit in (1.0, 1e-13):
        df = build_features(bars(spark, close * unit), ["w_rank", "w_prank"], "windows")
        ranks.append([(r["w_rank"], r["w_prank"]) for r in df.orderBy("date").collect()])
    assert ranks[0] == ranks[1]


def test_raw_scan_by_header(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Close,High,Low,Open,Volume\n2020-01-01,4,5,1,2,9\n")
    (tmp_path / "BBB.csv").write_text("open,VOLUME,adj close,date,low,high\n2,9,3.5,2020-01-02,1,5\n")
    (tmp_path / "CCC.csv").write_text("")
    got = {r["ticker"]: r.asDict() for r in tables.read_raw(spark, str(tmp_path)).collect()}
    assert got["AAA"] == {"date": "2020-01-01", "open": "2", "high": "5", "low": "1", "close": "4", "volume": "9", "adj close": None, "ticker": "AAA"}
    assert got["BBB"]["close"] is None and got["BBB"]["adj close"] == "3.5" and got["BBB"]["high"] == "5" and len(got) == 2


def test_sample_keeps_its_limits(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, "A").otherwise(F.concat(F.lit("T"), F.col("id") % 9)).alias("ticker"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("date"), "id")
    for rows in (1000, 500):
        counts = {r["ticker"]: r["count"] for r in tables.sampled_scan(df, rows).groupBy("ticker").count().collect()}
        assert max(counts.values()) == rows // 10 and sum(counts.values()) == rows
    assert sorted(tables.sampled_scan(df, 500).collect()) == sorted(tables.sampled_scan(df.repartition(3), 500).collect())


def test_no_machine_local_cuts_on_a_cluster():
    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[2,1,1024]"))
    assert shared_folder(session("local[4]")) and shared_folder(session("spark://host:7077"))


def test_no_trades_give_zeros(spark):
    none = tables.empty_trades(spark)
    row = trade_metrics(none).first().asDict()
    assert all(row[c] == 0 for c in ("n_trades", "win_rate", "avg_return", "avg_pnl", "max_drawdown", "avg_holding_days", "max_concurrent_positions", "total_pnl"))


def test_sweep_and_presets_against_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 200), np.round(rng.random(200), 2))] + [(1, None), (None, 0.5), (None, None)]
    got = {r["threshold"]: r for r in threshold_sweep(spark.createDataFrame(rows, "y int, p double"), "y", "p").collect()}
    known = [(y, p) for y, p in rows if y is not None and p is not None]
    for t, r in got.items():
        tp, fp = sum(y == 1 and p >= t for y, p in known), sum(y == 0 and p >= t for y, p in known)
        assert r["positive_predictions"] == tp + fp and r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r["recall"] == pytest.approx(tp / sum(y for y, _ in known))
    assert len(got) == 17
    trades = spark.createDataFrame([(0.1, "target", 1.0), (-0.2, "stop_loss", 2.0), (0.3, "target", 3.0)], "`return` double, exit_reason string, f double")
    out = {r["preset"]: r for r in preset_comparison(trades, {"high": [("f", ">", 1.5)], "all": []}).collect()}
    assert out["high"]["remaining_trades"] == 2 and out["high"]["winners_excluded_pct"] == 50 and out["all"]["remaining_trades"] == 3


def test_all_features_share_their_exchanges(spark, walk):
    """Prices are dealt out once for all side tables, once for the windows and once for each level of ranks."""
    _, bars, _, market = walk
    sectors = spark.createDataFrame([("AAA", "Technology"), ("BBB", "Energy")], "ticker string, sector string")
    out = build_features(bars, list(V3), market=market, sector_bars=market.withColumn("ticker", F.lit("XLK")), sectors=sectors)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 15


def test_headers_come_from_first_lines(spark, tmp_path):
    import gzip
    (tmp_path / "A.csv").write_text("Date,Close,Volume\n2020-01-02,1.5,7\ndate,9,9\n")
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "B.csv.gz", "wt") as f:
        f.write('"volume","date","extra"\n5,2020-01-03,x\n')
    (tmp_path / "C.csv").write_text("day,close\n2020-01-02,1\n")
    (tmp_path / "D.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("date,close\n2020-01-02,1\n")
    got = {tuple(r) for r in tables.read_raw(spark, str(tmp_path)).select("date", "close", "volume", "extra").collect()}
    assert got == {("2020-01-02", "1.5", "7", None), ("date", "9", "9", None), ("2020-01-03", None, "5", "x")}
    assert len(tables.first_lines(spark, str(tmp_path))) == 4
