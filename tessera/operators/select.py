"""Feature selection.  Features are first coerced to double with nulls as 0.

Every score comes from one aggregate over the table: variances, the upper
triangle of correlations, per-class (count, Σx, Σx²) for ANOVA F, or
correlation with the target for regression F.  The result is a small
``(feature, score, selected)`` DataFrame plus the kept feature list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric, wide_agg
from ..plans.products import pair_correlations


def _report(spark, feats: list[str], scores: dict, selected: list[str]) -> DataFrame:
    rows = [(f, None if scores.get(f) is None or (isinstance(scores[f], float)
             and math.isnan(scores[f])) else float(scores[f]), f in selected) for f in feats]
    return spark.createDataFrame(rows, "feature string, score double, selected boolean")


def select_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.05):
    feats = list(features)
    row = wide_agg(df, [F.var_pop(coerce_numeric(c)).alias(c) for c in feats])
    sel = [c for c in feats if row[c] is not None and row[c] > threshold]
    return sel, _report(df.sparkSession, feats, row, sel)


def select_correlation(df: DataFrame, features: Sequence[str], threshold: float = 0.9):
    """Drop column j when any earlier column i (dropped or not) has |r| > threshold."""
    feats = list(features)
    row = {f"{r['i']}_{r['j']}": r["r"] for r in  # a row per pair of features
           pair_correlations(df, [coerce_numeric(c) for c in feats]).where("i < j").collect()}
    dropped = []
    worst = {}
    for j, b in enumerate(feats):
        rs = [abs(row[f"{i}_{j}"]) for i in range(j)
              if row.get(f"{i}_{j}") is not None and not math.isnan(row[f"{i}_{j}"])]
        worst[b] = max(rs) if rs else 0.0
        if any(r > threshold for r in rs):
            dropped.append(b)
    sel = [c for c in feats if c not in dropped]
    return sel, _report(df.sparkSession, feats, worst, sel)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> dict:
    """One-way ANOVA F per feature from per-class count / Σx / Σx²."""
    feats = list(features)
    g = df.groupBy(F.col(label).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(coerce_numeric(c)).alias(f"s_{i}") for i, c in enumerate(feats)],
        *[F.sum(coerce_numeric(c) * coerce_numeric(c)).alias(f"q_{i}")
          for i, c in enumerate(feats)]).collect()
    k = len(g)
    n = sum(r["_n"] for r in g)
    out = {}
    for i, c in enumerate(feats):
        s_all = sum(r[f"s_{i}"] for r in g)
        q_all = sum(r[f"q_{i}"] for r in g)
        ss_all = q_all - s_all * s_all / n
        ssb = sum(r[f"s_{i}"] ** 2 / r["_n"] for r in g) - s_all * s_all / n
        ssw = ss_all - ssb
        dfb, dfw = k - 1, n - k
        if dfb <= 0 or dfw <= 0 or ssw <= 0:
            out[c] = float("nan") if ssw <= 0 and ssb <= 0 else (float("inf") if dfb > 0 else float("nan"))
        else:
            out[c] = (ssb / dfb) / (ssw / dfw)
    return out


def regression_f(df: DataFrame, features: Sequence[str], label: str) -> dict:
    feats = list(features)
    y = coerce_numeric(label)
    row = wide_agg(df, [F.count(F.lit(1)).alias("_n")] +
                   [F.corr(coerce_numeric(c), y).alias(c) for c in feats])
    n = row["_n"]
    out = {}
    for c in feats:
        r = row[c]
        if r is None or math.isnan(r):
            out[c] = float("nan")
        elif abs(r) >= 1:
            out[c] = float("inf")
        else:
            out[c] = r * r / (1 - r * r) * (n - 2)
    return out


def is_classification_target(df: DataFrame, label: str) -> bool:
    """String target, or fewer than 10 distinct values."""
    if dict(df.dtypes)[label] == "string":
        return True
    return df.select(label).distinct().limit(10).count() < 10


def select_kbest(df: DataFrame, features: Sequence[str], label: str, k: int = 10,
                 problem: str | None = None):
    """Top-k by F score (NaN scores rank lowest); kept in input order."""
    feats = list(features)
    cls = is_classification_target(df, label) if problem is None else problem == "classification"
    scores = anova_f(df, feats, label) if cls else regression_f(df, feats, label)
    k = min(k, len(feats))
    key = {c: (-math.inf if math.isnan(s) else s) for c, s in scores.items()}
    top = sorted(feats, key=lambda c: (-key[c], feats.index(c)))[:k]
    sel = [c for c in feats if c in top]
    return sel, _report(df.sparkSession, feats, scores, sel)


def select_rfe(df: DataFrame, features: Sequence[str], label: str, k: int = 10,
               problem: str = "classification", num_trees: int = 50, seed: int = 42):
    """Recursive elimination: fit a forest, drop the least important feature,
    repeat until k remain.  Each fit is a distributed ``pyspark.ml`` job."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    feats = list(features)
    data = df.select(*[coerce_numeric(c).alias(c) for c in feats],
                     F.col(label).cast("double").alias("_label")).cache()
    importances = {}
    while len(feats) > max(k, 1):
        va = VectorAssembler(inputCols=feats, outputCol="_features")
        est = (RandomForestClassifier if problem == "classification" else RandomForestRegressor)(
            featuresCol="_features", labelCol="_label", numTrees=num_trees, seed=seed)
        model = est.fit(va.transform(data))
        imp = model.featureImportances.toArray()
        importances.update({f: float(v) for f, v in zip(feats, imp)})
        worst = min(range(len(feats)), key=lambda i: (imp[i], -i))
        feats.pop(worst)
    data.unpersist()
    return feats, _report(df.sparkSession, list(features), importances, feats)


def select_features(df: DataFrame, features: Sequence[str], label: str | None = None,
                    method: str = "none", k: int = 10, threshold: float = 0.05):
    if method in ("none", "", None):
        return list(features), None
    if method == "variance":
        return select_variance(df, features, threshold)
    if method == "correlation":
        return select_correlation(df, features, threshold)
    if method == "kbest":
        if label is None:
            return list(features), None
        return select_kbest(df, features, label, k)
    if method == "rfe":
        if label is None:
            return list(features), None
        return select_rfe(df, features, label, k)
    raise ValueError(f"unknown selection method {method}")
