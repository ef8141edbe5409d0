import numpy as np
import pandas as pd
import pytest

from dailybars.plans.kernels import KERNELS, add_kernels, price_series
from dailybars.plans.recurrences import Adaptive, Smoother, compose, scan


def ewma(x, alpha, skip=False):
    return x.ewm(alpha=alpha, adjust=False, ignore_na=skip).mean()


def wilder(x, p):
    out = np.full(len(x), np.nan)
    for i in range(min(p, len(x))):
        out[i] = np.nanmean(x[:i + 1]) if (~np.isnan(x[:i + 1])).any() else np.nan
    if len(x) > p:
        out[p - 1:] = ewma(pd.Series(np.r_[out[p - 1], x[p:]]), 1.0 / p)
    return out


def kama(d):
    s = {k: np.asarray(v, float) for k, v in price_series(d).items()}
    out = s["mean10"].copy()
    for i in range(10, len(out)):
        if not np.isnan(out[i - 1]) and not np.isnan(s["rate"][i]):
            out[i] = out[i - 1] + s["rate"][i] * (s["c"][i] - out[i - 1])
    return out


def whole(d):
    """Every smoother over a whole ticker, by pandas and plain loops."""
    s = {k: pd.Series(np.asarray(v, float)) for k, v in price_series(d).items()}
    ema = lambda n: ewma(s["c"], 2 / (n + 1))
    macd, want = ema(12) - ema(26), {}
    want["k_macd_sig"] = ewma(macd, 0.2)
    want["k_ppo_sig"] = ewma(macd / ema(26), 0.2)
    want["k_tsi_num"], want["k_tsi_den"] = (ewma(ewma(s[k], 2 / 26), 2 / 14) for k in ("move", "size"))
    want["k_vol_sq"] = ewma(s["square"], 0.06, skip=True)
    want["k_kama"] = kama(d)
    want["k_wilder14"] = wilder(s["c"].to_numpy(), 14)
    for n in (5, 10, 12, 20, 26, 50, 200):
        want[f"k_ema{n}"] = ema(n)
    for p in (14, 20, 50):
        r, u, v = (pd.Series(wilder(s[k].to_numpy(), p)) for k in ("range", "up", "down"))
        r = r.replace(0.0, np.nan)
        u, v = 100 * u / r, 100 * v / r
        want[f"k_adx{p}"] = (ewma(100 * (u - v).abs() / (u + v).replace(0.0, np.nan), 2 / (p + 1)) / 100).clip(0, 1)
    return {k: np.asarray(v, float) for k, v in want.items()}


def bars(rows, nulls=(), closes=(), seed=5):
    rng = np.random.default_rng(seed)
    c = 100 * np.cumprod(1 + rng.normal(0, 0.01, rows))
    d = pd.DataFrame({"h": c * (1 + rng.uniform(0, 0.01, rows)), "l": c * (1 - rng.uniform(0, 0.01, rows)), "c": c})
    for a, b in nulls:
        d.loc[a:b - 1, ["h", "l", "c"]] = np.nan
    for a, b in closes:
        d.loc[a:b - 1, "c"] = np.nan
    d.insert(0, "rn", np.arange(1, rows + 1))
    return d


def through_spark(spark, d, block):
    df = spark.createDataFrame(d.assign(ticker="A", n_rows=len(d)).replace({np.nan: None}), "rn bigint, h double, l double, c double, ticker string, n_rows bigint")
    return add_kernels(df, KERNELS, block).orderBy("rn").toPandas()


def test_blocks_of_50_rows_equal_one_block_and_pandas_over_a_null_stretch(spark):
    """10,000 nulls cover two hundred blocks; weights age over them, the volatility smoother's do not."""
    d = bars(13_500, [(30, 31), (300, 306), (11_000, 13_000)], [(700, 10_700)])
    cut, one, want = through_spark(spark, d, 50), through_spark(spark, d, 20_000), whole(d)
    assert len(cut) == len(one) == len(d)
    for n in KERNELS:
        np.testing.assert_allclose(cut[n].to_numpy(float), one[n].to_numpy(float), rtol=1e-12, atol=1e-12, err_msg=n)
        np.testing.assert_allclose(one[n].to_numpy(float), want[n], rtol=1e-10, atol=1e-12, err_msg=n)


@pytest.mark.parametrize("rows, nulls", [(1, []), (7, []), (60, [(0, 60)]), (400, [(0, 70)]), (160, [(0, 3), (100, 160)]), (333, [(49, 51), (99, 151)])])
def test_short_and_empty_starts(spark, rows, nulls):
    d = bars(rows, nulls, seed=rows)
    got, want = through_spark(spark, d, 50), whole(d)
    for n in KERNELS:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n], rtol=1e-10, atol=1e-12, err_msg=n)


def test_scan_equals_a_loop():
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 1, 777), rng.normal(0, 1, 777)
    p, q = scan(a, b)
    y = 3.0
    for i in range(777):
        y = a[i] * y + b[i]
        assert abs(p[i] * 3.0 + q[i] - y) < 1e-12


def test_composition_needs_no_rows():
    """Summaries alone give every block its start."""
    x = np.array([1.0, np.nan, 2.0, np.nan, np.nan, np.nan, np.nan, 5.0, 4.0])
    s = Smoother("y", "x", 0.25)
    blocks = [s.steps({"x": x[i:i + 3]}, np.arange(i + 1, i + 4))[2] for i in (0, 3, 6)]
    entered = compose([s], [[b] for b in blocks])
    want = ewma(pd.Series(x), 0.25)
    assert np.isnan(entered[0][0][0]) and entered[1][0][0] == pytest.approx(want[2]) and entered[2][0][0] == pytest.approx(want[5])
    assert entered[2][1][0] == pytest.approx(want[7])


def test_an_adaptive_smoother_starts_anew_without_a_rate():
    s = Adaptive("y", "x", "rate", "start")
    data = {"x": np.array([1.0, 2.0, 3.0, 4.0]), "rate": np.array([0.5, np.nan, np.nan, 0.5]), "start": np.array([9.0, np.nan, 7.0, 9.0])}
    p, q, brief = s.steps(data, np.arange(5, 9))
    assert p.tolist() == [0.5, 0.0, 0.0, 0.0] and q[0] == 0.5 and np.isnan(q[1]) and q[2:].tolist() == [7.0, 5.5]
    assert compose([s], [[brief]])[0][1] != [0.0]


def test_a_block_must_hold_the_seed():
    with pytest.raises(ValueError, match="first 14"):
        Smoother("y", "x", 1 / 14, seed=14).steps({"x": np.ones(5)}, np.arange(6, 11))
