"""Statistical fits of many series as normal equations.

A fit needs of a series only the cross products of its regressors.  Rows are dealt
into blocks of consecutive indices, each with the few rows before it that lags reach
(a halo), a block adds up its products, and the products of a series' blocks are
summed in Spark.  So a series of any length, or a single one, is spread over many
tasks, and what is solved per series is a matrix of some dozen columns.

* ``adf_test``: the Dickey–Fuller regression, its lag chosen by AIC.
* ``forecast_arma``: ARIMA (1,1,1), or ×(1,1,1)_s, by two-stage least squares: a long
  autoregression supplies the innovations that the second regression takes as
  regressors.
* ``forecast_trend``: piecewise-linear trend with ridge-penalised changepoints, and
  Fourier terms.

Every series returns rows: those too short for a fit one row with ``status``
``too_short`` and nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import join_small
from ..plans.lineage import cut

BLOCK = 4096
OK, SHORT = "ok", "too_short"


def _standardised(df: DataFrame, order, value, by, center: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows ``(by, _i, _n, _y)`` cut to disk, and per series ``_n, _mean, _std``."""
    from .series import indexed
    idx = indexed(df.select(*by, *order, F.col(value).cast("double").alias(value)), order, value, by) \
        .select(*by, "_i", "_n", F.col(value).alias("_v"))
    idx = cut(idx)
    stats = cut(idx.groupBy(*by).agg(F.first("_n").alias("_n"), F.avg("_v").alias("_mean"),
                                     F.coalesce(F.stddev_pop("_v"), F.lit(0.0)).alias("_std")))
    stats = stats.withColumn("_std", F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0))
    rows = join_small(idx, stats.drop("_n"), by).withColumn(
        "_y", (F.col("_v") - (F.col("_mean") if center else F.lit(0.0))) / F.col("_std"))
    return rows.select(*by, "_i", "_n", "_y"), stats


def _products(rows: DataFrame, by: Sequence[str], halo: int, design: Callable, extra: Sequence[str] = ()) -> DataFrame:
    """``(by, _gram)``: summed upper triangles of ZᵀZ, Z = ``design(i, y, n, extra)`` over the
    block's own rows (rows of Z that are not finite are left out)."""
    block = max(BLOCK, 2 * halo)
    own = F.floor(F.col("_i") / block)
    spread = rows.withColumn("_b", F.explode(F.when(
        F.col("_i") % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own)))) if halo else \
        rows.withColumn("_b", own)
    keys = T.StructType([rows.schema[b] for b in by])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        i = pdf["_i"].to_numpy()
        z = design(i, pdf["_y"].to_numpy(), int(pdf["_n"].iloc[0]),
                   [pdf[c].iloc[0] for c in extra])
        z = z[(i // block == pdf["_b"].iloc[0]) & np.isfinite(z).all(axis=1)]
        g = (z.T @ z)[np.triu_indices(z.shape[1])]
        out = pd.DataFrame({"_k": np.arange(len(g), dtype=np.int32), "_g": g})
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "_k", "_g"]]

    schema = T.StructType([*keys.fields, T.StructField("_k", T.IntegerType()), T.StructField("_g", T.DoubleType())])
    parts = spread.groupBy(*by, "_b").applyInPandas(run, schema)
    return parts.groupBy(*by, "_k").agg(F.sum("_g").alias("_g")).groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_k", "_g"))), lambda x: x["_g"]).alias("_gram"))


def _square(triangle) -> np.ndarray:
    k = int((math.sqrt(8 * len(triangle) + 1) - 1) / 2)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = triangle
    return m + np.triu(m, 1).T


def _lag(y: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(y), np.nan)
    if k < len(y):
        out[k:] = y[:len(y) - k]
    return out


def _per_series(rows: DataFrame, by, solve: Callable, fields: str) -> DataFrame:
    """``solve(row) -> list of tuples`` for each series row."""
    schema = T.StructType([rows.schema[b] for b in by] + T._parse_datatype_string(fields).fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            out = [(*[r[b] for b in by], *t) for r in pdf.to_dict("records") for t in solve(r)]
            frame = pd.DataFrame(out, columns=names)
            for f in schema.fields:
                if isinstance(f.dataType, (T.IntegerType, T.LongType)):
                    frame[f.name] = frame[f.name].astype("Int64")
            yield frame

    return rows.mapInPandas(run, schema)


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """A constant key stands in for a single series."""
    return (df, list(by), []) if by else (df.withColumn("_one", F.lit(0)), ["_one"], ["_one"])


# Published response-surface coefficients of the ADF p-value with a constant (fixed values).
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALLP = [2.1659, 1.4412, 0.038269]
_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]


def adf_pvalue(stat: float) -> float:
    if stat > _TAU_MAX:
        return 1.0
    if stat < _TAU_MIN:
        return 0.0
    x = sum(c * stat ** i for i, c in enumerate(_SMALLP if stat <= _TAU_STAR else _LARGEP))
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _max_lag(n: int) -> int:
    return max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))


def adf_from_products(gram: np.ndarray) -> tuple[float, int]:
    """t statistic of y[t-1] and the lag of least AIC, from the products of
    [1, y[t-1], dy[t-1] … dy[t-L], dy[t]]."""
    rows, target = gram[0, 0], gram[-1, -1]
    best = None
    for lag in range(len(gram) - 2):
        k = lag + 2
        xx, xy = gram[:k, :k], gram[:k, -1]
        inv = np.linalg.pinv(xx)
        beta = inv @ xy
        sse = max(float(target - beta @ xy), 1e-300)
        aic = rows * math.log(sse / rows) + 2 * k
        if best is None or aic < best[0]:
            best = (aic, beta[1] / math.sqrt(max(inv[1, 1] * sse / max(rows - k, 1), 1e-300)), lag)
    return best[1], best[2]


def adf_test(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per series: n, ADF statistic, p-value, lag used, stationary (p < 0.05); a series
    of fewer than ten values has nulls and ``is_stationary`` false."""
    df, by, drop = _grouped(df, by)
    rows, stats = _standardised(df, list(order), value, by)
    longest = stats.agg(F.max("_n")).first()[0] or 0

    def design(i, y, n, _):
        lags = _max_lag(n)
        d = y - _lag(y, 1)
        z = np.column_stack([np.ones(len(y)), _lag(y, 1), *[_lag(d, j) for j in range(1, lags + 1)], d])
        z[i < lags + 1] = np.nan
        return z

    gram = _products(rows.where("_n >= 10"), by, _max_lag(longest) + 1, design)

    def solve(r):
        if r["_gram"] is None or r["_n"] < 10:
            return [(int(r["_n"]), None, None, None, False)]
        stat, lag = adf_from_products(_square(r["_gram"]))
        p = adf_pvalue(stat)
        return [(int(r["_n"]), stat, p, lag, p < 0.05)]

    return _per_series(stats.select(*by, "_n").join(gram, by, "left"), by, solve,
                       "n long, adf_statistic double, adf_pvalue double, used_lag int, is_stationary boolean").drop(*drop)


def _regressors(w: np.ndarray, e: np.ndarray, s: int) -> list[np.ndarray]:
    """Lags of a (1,1)×(1,1)_s model in the differenced series and its innovations."""
    lags = [1] if not s else [1, s, s + 1]
    return [_lag(w, k) for k in lags] + [_lag(e, k) for k in lags]


def forecast_arma(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
                  horizon: int = 10, seasonal: int = 0) -> DataFrame:
    """``(by, step, forecast, aic, status)`` of ARIMA(1,1,1), or ×(1,1,1)_s."""
    df, by, drop = _grouped(df, by)
    rows, stats = _standardised(df, list(order), value, by)
    s = int(seasonal)
    least = max(horizon + 2, 2 * s + 4, 8)
    fit = rows.where(F.col("_n") >= least)
    reach = s + 1  # differences

    def differenced(y):
        d = y - _lag(y, 1)
        return d - _lag(d, s) if s else d

    def order_of(n):
        return int(max(1, min(20 + s, (n - reach) // 4)))

    def first(i, y, n, _):
        w = differenced(y)
        return np.column_stack([np.ones(len(y)), *[_lag(w, k) for k in range(1, order_of(n) + 1)], w])

    most = 20 + s
    long_ar = _products(fit, by, most + reach + 1, first)

    def solve_ar(r):
        g = _square(r["_gram"])
        return [([float(x) for x in np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1]],)]

    coefs = cut(_per_series(long_ar, by, solve_ar, "_ar array<double>"))

    def innovations(w, ar):
        e = w - ar[0]
        for k, a in enumerate(ar[1:], 1):
            e = e - a * _lag(w, k)
        return e

    def second(i, y, n, extra):
        w = differenced(y)
        return np.column_stack([np.ones(len(y)), *_regressors(w, innovations(w, np.asarray(extra[0])), s), w])

    with_ar = join_small(fit, coefs, by)
    gram = _products(with_ar, by, most + 2 * reach + 2, second, ["_ar"])
    keep = most + 3 * reach + 3
    tail = fit.where(F.col("_i") >= F.col("_n") - keep).groupBy(*by).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_i", "_y"))), lambda x: x["_y"]).alias("_tail"))
    series = stats.join(gram, by, "left").join(coefs, by, "left").join(tail, by, "left")

    def solve(r):
        if r["_n"] < least or r["_gram"] is None:
            return [(None, None, None, SHORT)]
        g = _square(r["_gram"])
        xx, xy = g[:-1, :-1], g[:-1, -1]
        beta = np.linalg.pinv(xx) @ xy
        rows_, k = max(g[0, 0], 1.0), len(beta) + 1
        sse = max(float(g[-1, -1] - beta @ xy), 1e-300)
        aic = rows_ * math.log(sse / rows_ * r["_std"] ** 2) + 2 * k
        y = np.asarray(r["_tail"], dtype=float)
        w = differenced(y)
        e = innovations(w, np.asarray(r["_ar"]))
        w, e = list(np.nan_to_num(w)), list(np.nan_to_num(e))
        lags = [1] if not s else [1, s, s + 1]
        m = len(lags)
        ar = beta[1:1 + m].copy()
        if np.abs(ar).sum() >= 0.999:  # keep the recursion from exploding
            ar *= 0.999 / np.abs(ar).sum()
        d = list(np.diff(y))
        out, level = [], y[-1]
        for step in range(1, horizon + 1):
            nxt = beta[0] + sum(a * w[-k] for a, k in zip(ar, lags)) + sum(b * e[-k] for b, k in zip(beta[1 + m:], lags))
            w.append(nxt)
            e.append(0.0)
            d.append(nxt + (d[-s] if s else 0.0))
            level += d[-1]
            out.append((step, float(level * r["_std"] + r["_mean"]), float(aic), OK))
        return out

    return _per_series(series, by, solve, "step int, forecast double, aic double, status string").drop(*drop)


def forecast_trend(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (), horizon: int = 10,
                   changepoints: int = 25, penalty: float = 10.0,
                   periods=((7.0, 3), (365.25, 10))) -> DataFrame:
    """``(by, step, forecast, trend, status)``: trend and seasonality on the row index."""
    df, by, drop = _grouped(df, by)
    rows, stats = _standardised(df, list(order), value, by, center=False)
    least = horizon + 2

    def design(t, n):
        x = t / max(n - 1, 1)
        knots = np.linspace(0, 0.8, changepoints + 2)[1:-1] if n > 10 else []
        cols = [np.ones(len(t)), x, *[np.maximum(x - c, 0.0) for c in knots]]
        trend = len(cols)
        for period, terms in periods:
            for k in range(1, terms + 1):
                cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
        return np.column_stack(cols), trend

    gram = _products(rows.where(F.col("_n") >= least), by, 0,
                     lambda i, y, n, _: np.column_stack([design(i.astype(float), n)[0], y]))

    def solve(r):
        n = int(r["_n"])
        if n < least or r["_gram"] is None:
            return [(None, None, None, SHORT)]
        g = _square(r["_gram"])
        ahead, trend = design(np.arange(n, n + horizon, dtype=float), n)
        ridge = np.array([0.0, 0.0] + [penalty] * (trend - 2) + [1.0] * (ahead.shape[1] - trend))
        beta = np.linalg.solve(g[:-1, :-1] + np.diag(ridge + 1e-9), g[:-1, -1])
        fc, tr = ahead @ beta * r["_std"], ahead[:, :trend] @ beta[:trend] * r["_std"]
        return [(k + 1, float(fc[k]), float(tr[k]), OK) for k in range(horizon)]

    return _per_series(stats.join(gram, by, "left"), by, solve,
                       "step int, forecast double, trend double, status string").drop(*drop)
