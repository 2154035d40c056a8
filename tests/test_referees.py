"""Numeric kernels against independent computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapewright.operators.attribution import attribute
from tapewright.operators.chunks import bounds
from tapewright.operators.exposures import FACTOR_NAMES, fit_windows, median_fit, rolling_betas, window_sums
from tapewright.operators.linear import fit_folds
from tapewright.operators.metrics import cumulative, order_statistic
from tapewright.operators.simulate import BookConfig, simulate, simulate_day


def direct_fit(x, y, t, window, half_life, ridge):
    lo = max(0, t - window + 1)
    w = 0.5 ** (np.arange(t - lo, -1, -1) / half_life)
    a, b = x[lo : t + 1], y[lo : t + 1]
    beta = np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(x.shape[1]), (a * w[:, None]).T @ b)
    mean = np.average(b, weights=w)
    return beta, 1 - (w * (b - a @ beta) ** 2).sum() / (w * (b - mean) ** 2).sum(), t - lo + 1


def test_windows_equal_direct_regressions():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 4)) * 0.01])
    y = x @ [0.0001, 0.9, 0.2, -0.1, 0.05] + rng.normal(size=400) * 0.001
    got = fit_windows(x, y, 250, 120, 60.0, 1e-4)
    assert len(got) == 281
    for t in (119, 200, 249, 250, 399):
        beta, r2, n = direct_fit(x, y, t, 250, 60.0, 1e-4)
        assert np.allclose(got[t - 119, :5], beta, atol=1e-10) and got[t - 119, 5] == pytest.approx(r2) and got[t - 119, 6] == n


@pytest.mark.parametrize("odd", [np.nan, 1e6, -1e9])
@pytest.mark.parametrize("column", [1, 5])
def test_odd_values_leave_with_their_window(odd, column):
    rng = np.random.default_rng(11)
    n = 1100
    z = np.column_stack([np.ones(n), rng.normal(size=(n, 4)) * 0.01, rng.normal(size=n) * 0.01])
    z[400, column] = odd
    x, y = z[:, :5], z[:, 5]
    got = fit_windows(x, y, 250, 120, 60.0, 1e-4)
    for t in [*range(119, 400, 40), 399, 400, 401, 520, 649, 650, 651, 700, 899, 900, 1099]:
        beta, r2, nobs = direct_fit(x, y, t, 250, 60.0, 1e-4)
        held = 400 <= t < 650
        assert got[t - 119, 6] == nobs
        if held and np.isnan(odd):
            assert np.isnan(got[t - 119, :6]).all()
        elif not held:
            assert np.allclose(got[t - 119, :5], beta, rtol=1e-9, atol=1e-11) and got[t - 119, 5] == pytest.approx(r2, rel=1e-8)
        elif column == 1:
            assert np.allclose(got[t - 119, :5], beta, rtol=1e-5, atol=1e-7)
    assert np.isfinite(got[650 - 119 :]).all()


@pytest.mark.parametrize(("window", "half_life"), [(1, 3.0), (7, 0.01), (7, np.inf), (400, 1.0), (2000, 60.0)])
def test_window_sums_equal_loops(window, half_life):
    t = np.random.default_rng(12).normal(size=(500, 2))
    got = window_sums(t, window, half_life)
    for i in (0, 1, 6, 7, 13, 399, 400, 401, 499):
        part = t[max(0, i - window + 1) : i + 1]
        assert np.allclose(got[i], (part * (0.5 ** (np.arange(len(part))[::-1] / half_life))[:, None]).sum(0))
    assert window_sums(t[:0], window, half_life).shape == (0, 2)


def test_missing_factors_spoil_their_windows_only(spark):
    """A factor that is null on one date, read through the job: 250 windows have no fit, the others are as without it."""
    rng = np.random.default_rng(13)
    n = 700
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rows = [(d, *(rng.normal(size=4) * 0.01).tolist(), 0.0) for d in dates]
    rows[301] = (*rows[301][:2], None, *rows[301][3:])
    close = 100 * np.cumprod(1 + rng.normal(size=n) * 0.01)
    factors = spark.createDataFrame(rows, "date date, mkt_rf double, smb double, hml double, wml double, rf double")
    daily = spark.createDataFrame([("A", d, float(c)) for d, c in zip(dates, close, strict=True)], "sym string, date date, close double")
    got = rolling_betas(daily, factors, chunk=200).orderBy("date").toPandas()
    spoiled = got["mkt"].isna().to_numpy()
    assert spoiled.sum() == 250 and spoiled[300 - 119 : 550 - 119].all()
    whole = rolling_betas(daily, factors.fillna(0.0), chunk=5000).orderBy("date").toPandas()
    assert np.allclose(got["smb"][~spoiled], whole["smb"][~spoiled]) and got["r2"].isna().sum() == 250


def test_chunks_change_nothing(spark):
    rng = np.random.default_rng(3)
    n = 420
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    factors = pd.DataFrame({"date": dates, **{f: rng.normal(size=n) * 0.01 for f in FACTOR_NAMES}, "rf": 0.0})
    close = 100 * np.cumprod(1 + factors["mkt_rf"] * 0.9 + rng.normal(size=n) * 0.002)
    daily = spark.createDataFrame(pd.DataFrame({"sym": "A", "date": dates, "close": close}))
    f = spark.createDataFrame(factors)
    whole = rolling_betas(daily, f).orderBy("date").toPandas()
    parts = rolling_betas(daily, f, chunk=300).orderBy("date").toPandas()
    short = rolling_betas(daily, f, chunk=100).orderBy("date").toPandas()  # chunks shorter than a window
    assert len(whole) == n - 1 - 119 and len(parts) == len(whole) and (short["nobs"] == whole["nobs"]).all() and np.allclose(short["mkt"], whole["mkt"])
    assert np.allclose(whole[["alpha", "mkt", "r2", "nobs"]].astype(float), parts[["alpha", "mkt", "r2", "nobs"]].astype(float))
    assert abs(whole["mkt"].iloc[-1] - 0.9) < 0.15
    assert rolling_betas(daily.limit(0), f).count() == 0


def test_attribution_equals_the_double_sum(spark):
    """Two series of their own dates, out of order, a short one, and a constant one."""
    rng = np.random.default_rng(4)
    n, lags = 80, 5
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    f = rng.normal(size=(n, 4)) * 0.01
    factors = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(dates, f, strict=True)], "date date, mkt_rf double, smb double, hml double, wml double")
    series = {"a": np.arange(n), "b": np.arange(3, n, 2), "short": np.arange(8)}
    y = {s: 0.001 + f[at] @ [0.5, -0.2, 0.1, 0.0] + np.convolve(rng.normal(size=len(at) + 2), [1, 0.7, 0.3], "valid") * 0.01 for s, at in series.items()}
    rows = [(s, dates[i], float(v)) for s, at in series.items() for i, v in zip(at, y[s], strict=True)] + [("still", d, 0.25) for d in dates] + [("a", dates[0], None), ("a", dt.date(1999, 1, 1), 5.0)]
    rng.shuffle(rows)
    rows = [(s, d, None if v is None else float(v)) for s, d, v in rows]
    got = {r["series"]: r for r in attribute(spark.createDataFrame(rows, "series string, date date, ret double").repartition(3), factors, lags).collect()}
    for s, at in series.items():
        x = np.column_stack([np.ones(len(at)), f[at]])
        e = y[s] - x @ np.linalg.lstsq(x, y[s], rcond=None)[0]
        mid = sum(max(0, 1 - abs(i - j) / (lags + 1)) * e[i] * e[j] * np.outer(x[i], x[j]) for i in range(len(at)) for j in range(len(at)))
        inv = np.linalg.inv(x.T @ x)
        beta = inv @ x.T @ y[s]
        t = beta / np.sqrt(np.diag(inv @ mid @ inv))
        r = got[s]
        assert r["n"] == len(at) and r["alpha_annual"] == pytest.approx(beta[0] * 252) and r["r2"] == pytest.approx(1 - (e @ e) / ((y[s] - y[s].mean()) ** 2).sum())
        assert np.allclose([r[f"b_{c}"] for c in FACTOR_NAMES], beta[1:]) and np.allclose([r["alpha_t"], *(r[f"t_{c}"] for c in FACTOR_NAMES)], t, rtol=1e-5)
    assert got["still"]["r2"] is None or abs(got["still"]["b_mkt_rf"]) < 1e-9
    assert len(got) == 4


def test_near_collinear_features_keep_their_digits(spark):
    """Where a feature is nearly another one, moments lose the difference; triangles agree with direct least squares."""
    rng = np.random.default_rng(14)
    n = 5000
    a = rng.normal(size=n) * 3 + 50
    frame = pd.DataFrame({"label": "l", "date": [dt.date(2000 + i % 4, 1, 1 + i % 28) for i in range(n)], "a": a, "b": a + rng.normal(size=n) * 1e-6, "c": rng.normal(size=n), "d": 7.0})
    frame["y"] = 2 * frame["a"] - 1.5 * frame["b"] + 0.3 * frame["c"] + rng.normal(size=n) * 1e-7
    names = ["a", "b", "c", "d"]
    got = {r["fold"]: r for r in fit_folds(spark.createDataFrame(frame).repartition(7), spark.createDataFrame([("l", 2002), ("l", 2004)], "label string, fold int"), names).collect()}
    for fold, r in got.items():
        train = frame[[d.year < fold for d in frame["date"]]]
        sd = train[names].std().replace(0, 1)
        z = (train[names] - train[names].mean()) / sd
        want = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), train["y"].to_numpy(), rcond=1e-13)[0]
        scale = np.abs(want).max()
        assert r["n_train"] == len(train) and np.allclose(np.array(r["beta"]) / scale, want / scale, atol=1e-8)
        assert np.allclose(r["sd"], sd) and np.allclose(r["mu"], train[names].mean()) and r["beta"][4] == pytest.approx(0, abs=1e-9)
        x = z.to_numpy() - z.to_numpy().mean(0)
        moments = np.linalg.pinv(x.T @ x, rcond=1e-10, hermitian=True) @ (x.T @ train["y"].to_numpy())
        assert not np.allclose(moments / scale, want[1:] / scale, atol=1e-4)


@pytest.mark.parametrize("held", [3, 200])
def test_order_statistics_equal_sorting(spark, held):
    rng = np.random.default_rng(15)
    ties = np.round(rng.normal(size=3000), 1)
    cases = {"ties": ties, "wide": np.concatenate([rng.normal(size=500) * 10.0**e for e in (-300, 0, 300)]), "one": np.full(500, 2.5), "two": np.repeat([1.0, -1.0], [250, 251])}
    for name, v in cases.items():
        rows = [(float(x),) for x in v] + [(None,), (float("nan"),)] * 20
        df = spark.createDataFrame(rows, "x double").repartition(4)
        places = [0, 1, len(v) // 2, len(v) - 1]
        assert order_statistic(df, "x", places, held) == [float(np.sort(v)[p]) for p in places], name
    with pytest.raises(IndexError):
        order_statistic(df.limit(0), "x", [0])


def test_median_fit(spark):
    fits = lambda v: median_fit(spark.createDataFrame([(x,) for x in v], "r2 double")).first()
    assert tuple(fits([0.5, 0.1, None, 0.2, float("nan"), 0.2])) == (0.2, 4)
    assert tuple(fits([0.5, 0.1])) == (0.3, 2) and tuple(fits([])) == (None, 0)


def test_running_totals_in_chunks(spark):
    """One long series with crowded and missing dates, small ones, a null key: many chunks equal the window."""
    rng = np.random.default_rng(16)
    dates = sorted({dt.date(2000, 1, 1) + dt.timedelta(days=int(i)) for i in np.concatenate([rng.integers(0, 9000, 900), rng.integers(4000, 4300, 300)])})
    rows = [("long", d, None if i % 50 == 7 else float(rng.normal())) for i, d in enumerate(dates)] + [("small", d, 1.0) for d in dates[:5]] + [(None, d, 2.0) for d in dates[:700]] + [("none", dates[0], None)]
    df = spark.createDataFrame(rows, "s string, date date, v double").repartition(5)
    want = {}
    for s, d, v in rows:
        before = [x for x in rows if x[0] == s and x[1] <= d and x[2] is not None]
        want[s, d] = sum(x[2] for x in before) if before else None
    for target in (40, 10**6):
        got = cumulative(df, "v", ["s"], target).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["cumulative"] == (None if want[r["s"], r["date"]] is None else pytest.approx(want[r["s"], r["date"]], abs=1e-9))
    limits = {r["s"]: len(r["bounds"]) for r in bounds(df, ["s"], "date", 40).collect()}
    assert set(limits) == {"long", None} and limits["long"] >= 25


def panel(buckets, names, price=10.0):
    shape = (buckets, names)
    return np.ones(shape, bool), {"open": np.full(shape, price), "close": np.full(shape, price), "pred": np.tile(np.arange(names, dtype=float), (buckets, 1)), "beta": np.ones(shape)}


ONE = BookConfig(n_enter=1, n_exit=1, rebalance_every=2, notional=100.0)


def test_book_opens_and_closes_once():
    there, p = panel(12, 4)
    gross, fees, traded, sold, trades = simulate_day(there, p, ONE)
    # ten shares bought and ten sold short in bucket 1, both closed in the last bucket
    assert (gross, traded, sold, trades) == (0.0, 400.0, 200.0, 4)
    assert fees == pytest.approx(200 * 27.80e-6 + 20 * 0.000166)


def test_book_marks_at_open_and_close():
    there, p = panel(12, 4)
    p["close"][1:, 3] = 11.0
    p["open"][2:, 3] = 11.0
    gross, *_ = simulate_day(there, p, ONE)
    assert gross == pytest.approx(10.0)  # bought at 10, marked to 11 from then on; re-sized at later decisions


def test_order_whose_bar_is_missing_is_lost():
    there, p = panel(12, 4)
    there[1, 3] = False
    _, _, traded, _, trades = simulate_day(there, p, BookConfig(n_enter=1, n_exit=1, rebalance_every=20, notional=100.0))
    assert (traded, trades) == (200.0, 2)  # only the short side


def test_paper_fills_trade_the_same_shares():
    rng = np.random.default_rng(5)
    there, p = panel(20, 8)
    p["pred"] = rng.normal(size=p["pred"].shape)
    p["open"] = 10 + rng.normal(size=p["open"].shape)
    p["close"] = 10 + rng.normal(size=p["close"].shape)
    market, paper = (simulate_day(there, p, BookConfig(n_enter=1, n_exit=2, paper_fill=f)) for f in (False, True))
    assert market[4] == paper[4] and market[0] != paper[0]


def test_ties_go_by_symbol_and_short_days_have_no_row(spark):
    rows = [(dt.date(2024, 1, 2), s, b, 10.0, 10.0, 0.0, 1.0) for s in "ABCD" for b in range(12)] + [(dt.date(2024, 1, 3), s, b, 10.0, 10.0, 0.0, 1.0) for s in "ABCD" for b in range(9)]
    df = spark.createDataFrame(rows, "date date, sym string, bkt int, open double, close double, pred double, beta double")
    got = simulate(df, [ONE]).collect()
    assert [(r["date"].day, r["trades"]) for r in got] == [(2, 4)]
