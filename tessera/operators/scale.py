"""Scaling as column expressions from one aggregate pass.

The built-in ``pyspark.ml`` scalers use sample std (StandardScaler), map a
constant column to 0.5 (MinMaxScaler) and approximate medians (RobustScaler),
so the formulas are written out here:

* standard: (x − mean) / population std, std 0 → 1
* minmax:   (x − min) / (max − min), constant → 0
* robust:   (x − median) / IQR with interpolated quartiles, IQR 0 → 1
* power:    Yeo–Johnson with per-column maximum-likelihood λ, then standard
* quantile: empirical CDF (≤ 1000 reference quantiles) → standard normal
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_cols, sample_skew, wide_agg
from ..plans.ordering import quantile_table


@dataclass
class ScaleSpec:
    method: str
    params: dict = field(default_factory=dict)   # column -> dict of statistics

    def expr(self, c: str) -> Column:
        p = self.params[c]
        x = F.col(c).cast("double")
        m = self.method
        if m == "standard":
            return (x - F.lit(p["mean"])) / F.lit(p["scale"])
        if m == "minmax":
            return (x - F.lit(p["min"])) / F.lit(p["scale"])
        if m == "robust":
            return (x - F.lit(p["center"])) / F.lit(p["scale"])
        if m == "power":
            return (yeo_johnson(x, p["lambda"]) - F.lit(p["mean"])) / F.lit(p["scale"])
        if m == "quantile":
            return quantile_normal(x, p["quantiles"])
        return x

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method == "none" or not self.params:
            return df
        return df.select(*[self.expr(c).alias(c) if c in self.params else F.col(c)
                           for c in df.columns])


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = (F.log1p(x) if abs(lam) < 1e-12
           else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam))
    neg = (-F.log1p(-x) if abs(lam - 2.0) < 1e-12
           else -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


# Rational approximation of the standard normal quantile function
# (P. J. Acklam, 2003).  Fixed published coefficients.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]


def _poly(coefs, t: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * t + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    plow = 0.02425
    q = p - 0.5
    r = q * q
    central = _poly(_A, r) * q / (_poly(_B, r) * r + 1.0)
    ql = F.sqrt(-2.0 * F.log(p))
    lower = _poly(_C, ql) / ((_poly(_D, ql)) * ql + 1.0)
    qu = F.sqrt(-2.0 * F.log(1.0 - p))
    upper = -_poly(_C, qu) / ((_poly(_D, qu)) * qu + 1.0)
    return F.when(p < plow, lower).when(p > 1 - plow, upper).otherwise(central)


def _np_norm_ppf(p):
    """Vectorised Acklam approximation (same published coefficients as above)."""
    p = np.asarray(p, dtype=float)
    out = np.empty_like(p)
    plow = 0.02425
    lo = p < plow
    hi = p > 1 - plow
    mid = ~(lo | hi)
    q = p[mid] - 0.5
    r = q * q
    num = ((((_A[0] * r + _A[1]) * r + _A[2]) * r + _A[3]) * r + _A[4]) * r + _A[5]
    den = ((((_B[0] * r + _B[1]) * r + _B[2]) * r + _B[3]) * r + _B[4]) * r + 1
    out[mid] = num * q / den
    for mask, sign, src in ((lo, 1.0, p[lo]), (hi, -1.0, 1 - p[hi])):
        t = np.sqrt(-2 * np.log(src))
        num = ((((_C[0] * t + _C[1]) * t + _C[2]) * t + _C[3]) * t + _C[4]) * t + _C[5]
        den = (((_D[0] * t + _D[1]) * t + _D[2]) * t + _D[3]) * t + 1
        out[mask] = sign * num / den
    return out


def quantile_normal(x: Column, qs: list[float]) -> Column:
    """Empirical CDF on ≤ 1000 reference quantiles (two-sided interpolation so
    tied knots map to their midpoint), clipped at 1e-7, then the normal ppf.

    Runs as an Arrow-batched pandas UDF: ``np.interp`` over the (bounded) knot
    list is a vectorised binary search, which no built-in expression offers.
    """
    knots = np.asarray(qs, dtype=float)
    refs = np.linspace(0.0, 1.0, len(knots))
    eps = 1e-7

    @F.pandas_udf("double")
    def _transform(s: pd.Series) -> pd.Series:
        v = s.to_numpy(dtype=float, na_value=np.nan)
        p = 0.5 * (np.interp(v, knots, refs) - np.interp(-v, -knots[::-1], -refs[::-1]))
        p[v - eps < knots[0]] = 0.0
        p[v + eps > knots[-1]] = 1.0
        z = _np_norm_ppf(np.clip(p, eps, 1 - eps))
        z[np.isnan(v)] = np.nan
        return pd.Series(z)

    return _transform(x)


def _yj_lambda(df: DataFrame, cols: list[str]) -> dict:
    """Per-column λ maximising the Yeo–Johnson log-likelihood.  Each round
    evaluates a grid of λ for every column in one aggregate (Σψ, Σψ², n, and
    Σ sign·log1p|x|), then refines around the best λ."""
    lo = {c: -3.0 for c in cols}
    hi = {c: 3.0 for c in cols}
    best = {c: 1.0 for c in cols}
    for _ in range(4):
        grids = {c: [lo[c] + (hi[c] - lo[c]) * i / 12 for i in range(13)] for c in cols}
        exprs = []
        for j, c in enumerate(cols):
            x = F.col(c).cast("double")
            exprs.append(F.count(x).alias(f"n_{j}"))
            exprs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"sl_{j}"))
            for i, lam in enumerate(grids[c]):
                y = yeo_johnson(x, lam)
                exprs.append(F.sum(y).alias(f"s_{j}_{i}"))
                exprs.append(F.sum(y * y).alias(f"q_{j}_{i}"))
        row = wide_agg(df, exprs)
        for j, c in enumerate(cols):
            n = row[f"n_{j}"] or 0
            if n < 2:
                best[c] = 1.0
                continue
            scores = []
            for i, lam in enumerate(grids[c]):
                s, q = row[f"s_{j}_{i}"], row[f"q_{j}_{i}"]
                var = q / n - (s / n) ** 2
                if var is None or var <= 0 or math.isnan(var) or math.isinf(var):
                    scores.append(-math.inf)
                    continue
                scores.append(-n / 2 * math.log(var) + (lam - 1) * row[f"sl_{j}"])
            k = max(range(len(scores)), key=lambda i: scores[i])
            step = (hi[c] - lo[c]) / 12
            best[c] = grids[c][k]
            lo[c], hi[c] = best[c] - step, best[c] + step
    return best


def fit_scale(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard",
              approx: bool = False) -> ScaleSpec:
    cols = list(cols) if cols is not None else numeric_cols(df)
    if method == "none" or not cols:
        return ScaleSpec("none")
    if method == "auto":
        method = choose_scaler(df, cols)
    params: dict = {}
    if method == "standard":
        row = wide_agg(df, [e for c in cols for e in (
            F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
            F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))])
        for c in cols:
            s = row[f"s_{c}"]
            params[c] = {"mean": row[f"m_{c}"] or 0.0, "scale": s if s else 1.0}
    elif method == "minmax":
        row = wide_agg(df, [e for c in cols for e in (
            F.min(F.col(c).cast("double")).alias(f"a_{c}"),
            F.max(F.col(c).cast("double")).alias(f"b_{c}"))])
        for c in cols:
            a, b = row[f"a_{c}"], row[f"b_{c}"]
            rng = (b - a) if a is not None and b is not None else 0.0
            params[c] = {"min": a or 0.0, "scale": rng if rng else 1.0}
    elif method == "robust":
        qt = quantile_table(df, cols, [0.25, 0.5, 0.75], "linear", approx=approx)
        for c in cols:
            q1, q2, q3 = qt[c].get(0.25), qt[c].get(0.5), qt[c].get(0.75)
            iqr = (q3 - q1) if q1 is not None else 0.0
            params[c] = {"center": q2 or 0.0, "scale": iqr if iqr else 1.0}
    elif method == "power":
        lams = _yj_lambda(df, cols)
        row = wide_agg(df, [e for c in cols for e in (
            F.avg(yeo_johnson(F.col(c).cast("double"), lams[c])).alias(f"m_{c}"),
            F.stddev_pop(yeo_johnson(F.col(c).cast("double"), lams[c])).alias(f"s_{c}"))])
        for c in cols:
            s = row[f"s_{c}"]
            params[c] = {"lambda": lams[c], "mean": row[f"m_{c}"] or 0.0,
                         "scale": s if s else 1.0}
    elif method == "quantile":
        n = df.count()
        k = max(2, min(1000, n))
        probs = [i / (k - 1) for i in range(k)]
        qt = quantile_table(df, cols, probs, "linear", approx=approx)
        for c in cols:
            params[c] = {"quantiles": [qt[c][round(p, 12)] for p in probs]}
    else:
        raise ValueError(f"unknown scaling method {method}")
    return ScaleSpec(method, params)


def choose_scaler(df: DataFrame, cols: Sequence[str]) -> str:
    """Mean absolute (bias-corrected) skewness: > 1 power, > 0.5 quantile, else standard."""
    skew = mean_abs_skew(df, cols)
    if skew > 1.0:
        return "power"
    if skew > 0.5:
        return "quantile"
    return "standard"


def mean_abs_skew(df: DataFrame, cols: Sequence[str]) -> float:
    row = wide_agg(df, [sample_skew(F.col(c).cast("double")).alias(c) for c in cols])
    vals = [abs(row[c]) for c in cols if row[c] is not None and not math.isnan(row[c])]
    return sum(vals) / len(vals) if vals else 0.0


def scale(df: DataFrame, cols=None, method: str = "standard") -> DataFrame:
    return fit_scale(df, cols, method).apply(df)
