"""Model explanation.

* ``shap_importance``: for linear models the Shapley value of feature j on row
  x is coef_j·(x_j − E[x_j]) (independent features), so the mean |SHAP| is one
  aggregate over any number of rows; multi-class coefficients are averaged
  over classes.  Other models are explained on a stated number of sampled rows
  by ``kernel_shap``.
* ``lime_explain``: for many rows at once, every row is exploded into seeded
  perturbations, the model scores all of them in one ``transform``, and a
  kernel-weighted ridge fit per row runs in ``applyInPandas`` (groups are
  bounded by the number of perturbations).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric
from ..plans.lineage import cut
from . import learners as LR


def _linear_coefs(model) -> np.ndarray | None:
    est = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(est, "coefficientMatrix"):
        return est.coefficientMatrix.toArray()
    if hasattr(est, "coefficients"):
        return est.coefficients.toArray().reshape(1, -1)
    return None


def shap_importance(model, df: DataFrame, features: Sequence[str], sample: int = 200,
                    seed: int = 42) -> DataFrame:
    """``(feature, mean_abs_shap, method)`` sorted descending.  ``sample`` bounds the
    rows that a model without coefficients is explained on (chosen by a hash)."""
    features = list(features)
    coefs = _linear_coefs(model)
    spark = df.sparkSession
    if coefs is None:
        n = df.count()
        some = df.select(*features).where(F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(1 << 20))
                                          < min(1.0, sample / max(n, 1)) * (1 << 20)) if n > sample else df.select(*features)
        rows = cut(some.withColumn("_row", F.monotonically_increasing_id()))
        return shap_summary(kernel_shap(model, rows, features, "_row", background=df)) \
            .withColumn("method", F.lit("coalitions"))
    x = [coerce_numeric(c) for c in features]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    exprs = []
    for j, v in enumerate(x):
        per_class = [F.abs(F.lit(float(coefs[c, j])) * (v - F.lit(float(means[f"m{j}"]))))
                     for c in range(coefs.shape[0])]
        exprs.append(F.avg(sum(per_class) / len(per_class)).alias(f"s{j}"))
    row = df.agg(*exprs).first()
    pairs = sorted(((f, float(row[f"s{j}"])) for j, f in enumerate(features)), key=lambda p: -p[1])
    return spark.createDataFrame([(f, v, "linear_exact") for f, v in pairs],
                                 "feature string, mean_abs_shap double, method string")


def lime_explain(model, df: DataFrame, features: Sequence[str], key: str, n_samples: int = 200,
                 num_features: int = 10, kernel_width: float | None = None,
                 seed: int = 42) -> DataFrame:
    """Local linear weights for every row of ``df`` → ``(key, feature, weight,
    rank)``, top ``num_features`` per row, explaining the predicted class."""
    features = list(features)
    d = len(features)
    kw = kernel_width if kernel_width is not None else 0.75 * math.sqrt(d)
    stats = df.agg(*[F.stddev_pop(coerce_numeric(c)).alias(f"s{i}")
                     for i, c in enumerate(features)]).first()
    sd = [float(stats[f"s{i}"] or 1.0) or 1.0 for i in range(d)]
    base = df.select(F.col(key), *[coerce_numeric(c).alias(c) for c in features])
    pert = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))
    cols = []
    for i, c in enumerate(features):
        # seeded uniform noise scaled to unit variance (repeatable per row)
        z = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(
            (F.pmod(F.xxhash64(F.col(key), F.col("_s"), F.lit(seed + i)), F.lit(2 ** 20))
             / float(2 ** 20) - 0.5) * math.sqrt(12.0))
        cols.append((F.col(c) + z * F.lit(sd[i])).alias(c))
        cols.append(z.alias(f"_z{i}"))
    pert = pert.select(F.col(key), "_s", *cols)
    scored = model.transform(pert)
    if "probability" in scored.columns:
        prob = vector_to_array("probability")
        pred0 = scored.where(F.col("_s") == 0).select(F.col(key), F.col("prediction")
                                                     .alias("_cls"))
        scored = scored.join(pred0, key).withColumn(
            "_y", F.element_at(prob, F.col("_cls").cast("int") + 1))
    else:
        scored = scored.withColumn("_y", F.col("prediction").cast("double"))
    zc = [f"_z{i}" for i in range(d)]
    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, feature string, weight double, rank int"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        Z = pdf[zc].to_numpy(dtype=float)
        y = pdf["_y"].to_numpy(dtype=float)
        dist = np.sqrt((Z ** 2).sum(axis=1))
        w = np.sqrt(np.exp(-(dist ** 2) / kw ** 2))
        X = np.column_stack([np.ones(len(Z)), Z]) * w[:, None]
        A = X.T @ X + np.diag([0.0] + [1.0] * d)
        beta = np.linalg.solve(A, X.T @ (y * w))[1:]
        order = np.argsort(-np.abs(beta))[:num_features]
        return pd.DataFrame({key: pdf[key].iloc[0], "feature": [features[i] for i in order],
                             "weight": beta[order], "rank": np.arange(1, len(order) + 1,
                                                                      dtype="int32")})

    return scored.select(key, "_y", *zc).groupBy(key).applyInPandas(fit, schema)


MAX_EXACT_FEATURES = 12   # above it, orders of the features are sampled
SAMPLED_ORDERS = 32


def _coalitions(m: int, orders: int = SAMPLED_ORDERS, seed: int = 42) -> tuple[list[int], list[list[float]]]:
    """Coalitions (bit masks) and coef[j][i]: φ_j = Σ_i f(masks[i])·coef[j][i].  Exact
    up to MAX_EXACT_FEATURES: S containing j weighs |S−1|!(M−|S|)!/M!, one without it
    −|S|!(M−|S|−1)!/M!.  Beyond, ``orders`` random orders and their reverses: the mean
    over orders of what j adds to those before it."""
    if m <= MAX_EXACT_FEATURES:
        fact = [math.factorial(i) for i in range(m + 1)]
        size = [bin(mask).count("1") for mask in range(1 << m)]
        return list(range(1 << m)), [
            [fact[s - 1] * fact[m - s] / fact[m] if mask >> j & 1 else -fact[s] * fact[m - s - 1] / fact[m]
             for mask, s in enumerate(size)] for j in range(m)]
    rng = np.random.default_rng(seed)
    weights: dict[int, np.ndarray] = {}
    for _ in range(orders):
        order = rng.permutation(m).tolist()
        for way in (order, order[::-1]):
            mask = 0
            for j in way:
                for at, sign in ((mask, -1.0), (mask | 1 << j, 1.0)):
                    weights.setdefault(at, np.zeros(m))[j] += sign / (2 * orders)
                mask |= 1 << j
    masks = sorted(weights)
    return masks, [[float(weights[k][j]) for k in masks] for j in range(m)]


def kernel_shap(model, df: DataFrame, features: Sequence[str], key: str,
                target_class: int = 1, background: DataFrame | None = None) -> DataFrame:
    """Shapley values of any fitted model for every row of ``df`` with the column means
    (of ``background``, default ``df``) as the baseline: every row is expanded into
    feature coalitions (absent features at the baseline), all are scored in one
    ``transform``, and φ_j is a weighted sum of the coalition predictions — one
    aggregate per row key, no Python per row.  Exact up to 12 features, sampled orders
    beyond.  Explains the probability of ``target_class`` for classifiers, the
    prediction for regressors.  Returns ``(key, feature, shap)``."""
    features = list(features)
    m = len(features)
    x = [coerce_numeric(c) for c in features]
    means = (background if background is not None else df).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    masks, coefs = _coalitions(m)
    base = df.select(F.col(key), *[v.alias(c) for v, c in zip(x, features)])
    present = F.array(*[F.lit("".join("1" if mask >> j & 1 else "0" for j in range(m))) for mask in masks])
    exp = base.select("*", F.posexplode(present).alias("_at", "_mask"))
    exp = exp.select(F.col(key), "_at", *[
        F.when(F.substring("_mask", j + 1, 1) == "1", F.col(c))
         .otherwise(F.lit(float(means[f"m{j}"] or 0.0))).alias(c)
        for j, c in enumerate(features)])
    scored = model.transform(exp)
    if "probability" in scored.columns:
        f = F.element_at(vector_to_array("probability"), target_class + 1)
    else:
        f = F.col("prediction").cast("double")
    aggs = [F.sum(f * F.element_at(F.array(*[F.lit(c) for c in coefs[j]]), F.col("_at") + 1))
            .alias(f"_phi{j}") for j in range(m)]
    phi = scored.groupBy(key).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_phi{j}").alias("shap"))
                    for j, c in enumerate(features)])
    return phi.select(key, F.inline(arr))


def shap_summary(shap_rows: DataFrame) -> DataFrame:
    """Mean |SHAP| per feature, descending."""
    return shap_rows.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")) \
        .orderBy(F.col("mean_abs_shap").desc())
