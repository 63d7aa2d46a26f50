"""Series operators against numpy / pandas on small fixtures."""

import numpy as np
import pandas as pd

from tessera.operators import series as SR


def _frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        y = np.cumsum(rng.normal(size=40)) + (10 if g == "a" else 20)
        rows += [(g, i, float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "g string, t int, v double"), rows


def test_simple_forecasts(spark):
    df, rows = _frame(spark)
    for method in ("naive", "mean", "moving_avg", "linear", "drift"):
        got = {(r["g"], r["step"]): r["forecast"]
               for r in SR.forecast(df, ["t"], "v", ["g"], 5, method).collect()}
        for g in ("a", "b"):
            y = np.array([v for gg, _, v in rows if gg == g])
            n = len(y)
            slope, icpt = np.polyfit(np.arange(n), y, 1)
            want = {"naive": [y[-1]] * 5, "mean": [y.mean()] * 5,
                    "moving_avg": [y[-5:].mean()] * 5,
                    "linear": [icpt + slope * (n + s) for s in range(5)],
                    "drift": [icpt + slope * (n + s + 1) for s in range(5)]}[method]
            for s in range(5):
                assert abs(got[(g, s + 1)] - want[s]) < 1e-8


def test_rolling_bounds_match_pandas(spark):
    df, rows = _frame(spark)
    out = {(r["g"], r["t"]): (r["roll_mean"], r["upper"])
           for r in SR.rolling_bounds(df, ["t"], "v", ["g"], window=7, k=2.0, bucket=10).collect()}
    for g in ("a", "b"):
        s = pd.Series([v for gg, _, v in rows if gg == g])
        m, sd = s.rolling(7).mean(), s.rolling(7).std()
        for t in range(40):
            gm, gu = out[(g, t)]
            if t < 6:
                assert gm is None
            else:
                assert abs(gm - m[t]) < 1e-9 and abs(gu - (m[t] + 2 * sd[t])) < 1e-9


def test_arima_forecast_shape(spark):
    df, _ = _frame(spark)
    got = SR.forecast(df, ["t"], "v", ["g"], 5, "arima").collect()
    assert sorted((r["g"], r["step"]) for r in got) == [(g, s) for g in "ab" for s in range(1, 6)]
    assert all(np.isfinite(r["forecast"]) for r in got)


def test_no_series_is_dropped_and_no_horizon_cut(spark):
    rows = [("long", i, float(i % 9)) for i in range(700)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    for method in ("mean", "arima", "sarima", "prophet", "lag_model"):
        got = SR.forecast(df, ["t"], "v", ["g"], 600, method).collect()
        assert sorted(r["step"] for r in got if r["g"] == "long") == list(range(1, 601)), method
        assert [(r["step"], r["forecast"], r["status"]) for r in got if r["g"] == "short"] == [(None, None, "too_short")]


def test_wide_window_over_small_blocks(spark):
    df, rows = _frame(spark)
    out = {(r["g"], r["t"]): r["roll_mean"] for r in SR.rolling_bounds(df, ["t"], "v", ["g"], window=7, bucket=3).collect()}
    m = pd.Series([v for g, _, v in rows if g == "a"]).rolling(7).mean()
    assert all(abs(out[("a", t)] - m[t]) < 1e-9 for t in range(6, 40))


def test_adf_against_direct_regression(spark):
    from tessera.operators import series_fit as SF
    rng = np.random.default_rng(0)
    series = {"walk": np.cumsum(rng.normal(size=300)) + 1e6, "noise": rng.normal(size=150), "tiny": rng.normal(size=5)}
    df = spark.createDataFrame([(g, i, float(v)) for g, y in series.items() for i, v in enumerate(y)], "g string, t int, v double")
    got = {r["g"]: r for r in SF.adf_test(df, ["t"], "v", ["g"]).collect()}
    for g in ("walk", "noise"):
        y, best = series[g] - series[g].mean(), None
        lags = SF._max_lag(len(y))
        d = np.diff(y)
        for lag in range(lags + 1):
            x = np.column_stack([np.ones(len(d) - lags), y[lags:-1], *[d[lags - j:len(d) - j] for j in range(1, lag + 1)]])
            b, *_ = np.linalg.lstsq(x, d[lags:], rcond=None)
            sse = ((d[lags:] - x @ b) ** 2).sum()
            aic = len(x) * np.log(sse / len(x)) + 2 * x.shape[1]
            if best is None or aic < best[0]:
                best = (aic, b[1] / np.sqrt(sse / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), lag)
        assert abs(got[g]["adf_statistic"] - best[1]) < 1e-6 and got[g]["used_lag"] == best[2]
    assert got["noise"]["is_stationary"] and not got["walk"]["is_stationary"] and got["tiny"]["adf_statistic"] is None


def test_arma_recovers_its_process_across_blocks(spark, monkeypatch):
    from tessera.operators import series_fit as SF
    rng = np.random.default_rng(1)
    e = rng.normal(size=6000)
    w = np.zeros(6000)
    for t in range(1, 6000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
    y = np.cumsum(w)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t int, v double")
    small = SF.forecast_arma(df, ["t"], "v", horizon=3).orderBy("step").collect()
    monkeypatch.setattr(SF, "BLOCK", 100)
    again = SF.forecast_arma(df, ["t"], "v", horizon=3).orderBy("step").collect()
    want = y[-1] + 0.6 * w[-1] + 0.3 * e[-1]
    assert abs(small[0]["forecast"] - want) < 0.3
    assert all(abs(a["forecast"] - b["forecast"]) < 1e-6 for a, b in zip(small, again))


def test_trend_and_season_are_followed(spark):
    t = np.arange(200)
    y = 3 + 0.5 * t + 4 * np.sin(2 * np.pi * t / 7)
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, y)], "g string, t int, v double")
    got = SR.forecast(df, ["t"], "v", ["g"], 7, "prophet").orderBy("step").collect()
    ahead = np.arange(200, 207)
    want = 3 + 0.5 * ahead + 4 * np.sin(2 * np.pi * ahead / 7)
    assert max(abs(r["forecast"] - x) for r, x in zip(got, want)) < 3
