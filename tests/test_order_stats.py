import time

import numpy as np
import pandas as pd
import pytest

from dailybars.functions.terms import Sheet
from dailybars.plans.first_exit import chain_ends, chain_from, next_beyond
from dailybars.plans.order_stats import WindowCounts, _counts
from dailybars.plans.runs import _exits, run_starts
from dailybars.plans.sheets import run_sheet


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 100, 257])
@pytest.mark.parametrize("w", [1, 3, 50])
def test_counts_equal_a_scan_of_every_window(n, w):
    rng = np.random.default_rng(n * w)
    x = rng.integers(0, 12, n).astype(float)
    x[rng.random(n) < 0.15] = np.nan
    first, end, limit = np.maximum(np.arange(n) - w + 1, 0), np.arange(1, n + 1), rng.integers(-1, 14, n).astype(float)
    limit[::11] = np.nan
    counts = WindowCounts(x)
    assert counts.below(first, end, limit).tolist() == [int((x[a:b] < v).sum()) for a, b, v in zip(first, end, limit)]
    assert counts.below(first, end, limit, equal=True).tolist() == [int((x[a:b] <= v).sum()) for a, b, v in zip(first, end, limit)]


def test_batches_may_end_anywhere():
    rng = np.random.default_rng(1)
    x, group = rng.integers(0, 9, 400).astype(float), np.repeat([5, 6, 7], [150, 3, 247])
    rn, near = np.concatenate([np.arange(k) for k in (150, 3, 247)]), np.zeros(400)
    whole = _counts(rn, group, [x, near], [20], {})
    held, parts = {}, []
    for a, b in zip([0, 1, 30, 149, 152, 399], [1, 30, 149, 152, 399, 400]):
        parts.append(_counts(rn[a:b], group[a:b], [x[a:b], near[a:b]], [20], held))
    for k in (0, 1):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()


def test_ranks_in_a_sheet_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "rn": np.arange(1, n + 1), "n_rows": n, "c": rng.integers(1, 30, n).astype(float)}) for t, n in (("A", 700), ("B", 90), ("C", 1))])
    pdf.loc[pdf["c"] == 7, "c"] = np.nan
    df = spark.createDataFrame(pdf.replace({np.nan: None}), "ticker string, rn bigint, n_rows bigint, c double").repartition(3)
    for size in (64, 8192):
        sheet = Sheet()
        outputs = {"rank": sheet.prank(sheet.C, 40, 5), "of_rank": sheet.prank(sheet.prank(sheet.C, 40, 5), 10), "lagged": sheet.lag(sheet.prank(sheet.C, 40, 5), 3)}
        got = run_sheet(df, sheet, outputs, keep=(), size=size).toPandas().sort_values(["ticker", "rn"], ignore_index=True)
        c = pdf.sort_values(["ticker", "rn"], ignore_index=True).groupby("ticker")["c"]
        rank = c.rolling(40, min_periods=5).rank(pct=True).droplevel(0)
        of_rank = rank.groupby(got["ticker"]).rolling(10, min_periods=1).rank(pct=True).droplevel(0)
        for name, want in (("rank", rank), ("of_rank", of_rank), ("lagged", rank.groupby(got["ticker"]).shift(3))):
            np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-12, err_msg=f"{name} {size}")


def test_a_level_of_ranks_costs_one_more_exchange(spark, tmp_path):
    pdf = pd.DataFrame({"ticker": "A", "rn": np.arange(1, 101), "n_rows": 100, "c": np.arange(100.0)})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "c"))
    sheet = Sheet()
    made = run_sheet(spark.read.parquet(str(tmp_path / "c")), sheet, {"rank": sheet.avg(sheet.prank(sheet.diff(sheet.C), 40), 5)}, keep=())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("n", [1, 2, 5, 64, 300])
def test_runs_of_a_block_equal_a_walk(n):
    rng = np.random.default_rng(n)
    x, rn = np.round(np.cumsum(rng.normal(0, 0.1, n)), 2), np.arange(11, 11 + n)
    following = next_beyond(x, 0.2)
    assert following.tolist() == [next((j for j in range(i + 1, n) if abs(x[j] - x[i]) > 0.2), n) for i in range(n)]
    for i in range(0, n, 7):
        chain = [i]
        while following[chain[-1]] < n:
            chain.append(int(following[chain[-1]]))
        assert chain_from(i, following).tolist() == chain and chain_ends(following)[i] == chain[-1]
    for anchor, start in ((None, 0), (x[0] + 0.05, 4), (99.0, 4)):
        a, s, want = anchor, start, []
        for v, r in zip(x, rn):
            if a is None or abs(v - a) > 0.2:
                a, s = v, r
            want.append(s)
        assert run_starts(x, rn, 0.2, anchor, start).tolist() == want


def test_a_rising_series_is_not_quadratic():
    x = np.arange(8192) * 0.15
    started = time.time()
    seen, ends, starts = _exits(x, np.arange(1, 8193), 0.2)
    made = run_starts(x, np.arange(1, 8193), 0.2)
    assert time.time() - started < 1 and len(seen) == 8192 and len(set(starts)) == 2 and made[-1] >= 8191
