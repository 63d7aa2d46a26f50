"""Model evaluation: classification and regression metrics, curves, diagnostics.

Every classification metric derives from one ``groupBy(label, prediction)`` count, summed
by class and over the classes in Spark, however many there are.  Curves aggregate by distinct score first
(partial aggregation collapses hot scores) and then take skew-safe prefix
sums over the distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import exact_ranks, long_values, prefix_sums

EPS = 2.220446049250313e-16   # machine epsilon floor for MAPE denominators


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(class, t, p, tp)``: rows of each class, rows predicted as it, and rows that are both;
    null is a class.  Only a row per class results, and it stays in Spark."""
    counts = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n, none = F.col("n"), F.lit(0).cast("long")
    both = F.when(F.col("y").eqNullSafe(F.col("p")), n).otherwise(none)
    sides = F.array(F.struct(F.col("y").alias("class"), n.alias("t"), none.alias("p"), both.alias("tp")),
                    F.struct(F.col("p").alias("class"), none.alias("t"), n.alias("p"), none.alias("tp")))
    return counts.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])


def _rates(classes: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 (0 where there is nothing to divide by)."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = classes.withColumn("precision", share("tp", "p")).withColumn("recall", share("tp", "t"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def class_metrics(df: DataFrame, label: str, prediction: str) -> dict:
    """Accuracy, balanced accuracy, macro F1, Matthews correlation and Cohen's kappa; sums over
    the classes are taken in Spark, one row of them is read."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    r = _rates(per_class(df, label, prediction)).agg(
        F.sum("t").alias("n"), F.sum("tp").alias("correct"), F.avg(F.when(F.col("t") > 0, F.col("recall"))).alias("recall"),
        F.avg("f1").alias("f1"), F.sum(exact("t") * exact("p")).alias("tp"), F.sum(exact("t") * exact("t")).alias("tt"),
        F.sum(exact("p") * exact("p")).alias("pp")).first()
    n, correct = int(r["n"] or 0), int(r["correct"] or 0)
    tp, tt, pp = (int(r[c] or 0) for c in ("tp", "tt", "pp"))
    spread = (n * n - tt) * (n * n - pp)
    accuracy = correct / n if n else 0.0
    chance = tp / (n * n) if n else 0.0
    return {"accuracy": accuracy, "balanced_accuracy": r["recall"] or 0.0, "f1_macro": r["f1"] or 0.0,
            "mcc": (correct * n - tp) / math.sqrt(spread) if spread > 0 else 0.0,
            "cohen_kappa": (accuracy - chance) / (1 - chance) if chance != 1 else 0.0, "n": n}


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    m = class_metrics(df, label, prediction)
    return df.sparkSession.createDataFrame(
        [(m["accuracy"], m["balanced_accuracy"], m["f1_macro"], m["mcc"], m["cohen_kappa"], m["n"])],
        "accuracy double, balanced_accuracy double, f1_macro double, mcc double, "
        "cohen_kappa double, n long")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class precision / recall / f1 / support, then macro and weighted avg (null for a
    table without rows)."""
    rates = _rates(per_class(df, label, prediction))
    parts = ("precision", "recall", "f1")
    total = F.sum("t")
    each = rates.select(F.coalesce(F.col("class").cast("string"), F.lit("None")).alias("class"), *parts, F.col("t").alias("support"))
    macro = rates.agg(*[F.avg(c).alias(c) for c in parts], total.alias("support"))
    weighted = rates.agg(*[F.try_divide(F.sum(F.col(c) * F.col("t")), total.cast("double")).alias(c) for c in parts], total.alias("support"))
    named = lambda d, name: d.select(F.lit(name).alias("class"), *parts, "support")
    return each.unionByName(named(macro, "macro avg")).unionByName(named(weighted, "weighted avg"))


#: Parts that the cells of a class are dealt over.
CELL_PARTS = 64


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """label × prediction counts, zero-filled over the union of classes (a row per cell is
    the result).  Every class meets the others part by part, so no task makes all cells."""
    counts = df.groupBy(F.col(label).cast("string").alias("label"),
                        F.col(prediction).cast("string").alias("prediction")).count()
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("class")).distinct()
    rows = classes.select(F.col("class").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1))).alias("part"))
    across = classes.select(F.col("class").alias("prediction"), F.pmod(F.xxhash64("class"), F.lit(CELL_PARTS)).cast("int").alias("part"))
    zero = rows.join(across, "part").select("label", "prediction", F.lit(0).cast("long").alias("count"))
    return zero.unionByName(counts).groupBy("label", "prediction").agg(F.sum("count").alias("count"))


def _score_table(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Distinct scores with positive / negative counts (partial-aggregated)."""
    pos = (F.col(label) == F.lit(positive)).cast("long")
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, predicting positive when
    score ≥ threshold, and the origin (threshold infinity).  A rate over no rows
    is null."""
    st = _score_table(df, label, score, positive)
    tot = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    p, n = F.lit(float(tot["P"] or 0)), F.lit(float(tot["N"] or 0))
    cum = prefix_sums(st, ["threshold"], ["pos", "neg"], descending=True)
    out = cum.select("threshold", F.try_divide("cum_neg", n).alias("fpr"),
                     F.try_divide("cum_pos", p).alias("tpr"))
    zero = F.lit(0.0)
    return out.unionAll(df.sparkSession.range(1).select(
        F.lit(float("inf")), F.try_divide(zero, n), F.try_divide(zero, p)))


def precision_recall_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, and the end point
    (threshold null, precision 1, recall 0).  Recall over no positives is null."""
    st = _score_table(df, label, score, positive)
    tot = st.agg(F.sum("pos").alias("P")).first()
    cum = prefix_sums(st, ["threshold"], ["pos", "neg"], descending=True)
    p = F.lit(float(tot["P"] or 0))
    out = cum.select("threshold",
                     F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                     F.try_divide("cum_pos", p).alias("recall"))
    return out.unionAll(df.sparkSession.range(1).select(
        F.lit(None).cast("double"), F.lit(1.0), F.try_divide(F.lit(0.0), p)))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> float:
    """Rank-sum AUC with average ranks for ties (binary)."""
    st = _score_table(df, label, score, positive)
    cum = prefix_sums(st, ["threshold"], ["neg"], descending=False)
    agg = cum.agg(F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0))
                  .alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    if not agg["P"] or not agg["N"]:
        return float("nan")
    return agg["u"] / (agg["P"] * agg["N"])


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """rmse, mae, r2, mape, medae, explained_variance (population variances) over the
    rows where both values are present; ``n`` counts these."""
    df = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    e = y - p
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"),
                 F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("vy"),
                 F.var_pop(e).alias("ve"), F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS)))
                 .alias("mape")).first()
    n = row["n"]
    lv = long_values(df.select(F.abs(e).alias("abs_err")), ["abs_err"]).where(
        F.col("value").isNotNull())
    if n:
        lo, hi = (n - 1) // 2 + 1, n // 2 + 1
        got = exact_ranks(lv, {"abs_err": (n, sorted({lo, hi}))})
        medae = (got[("abs_err", lo)] + got[("abs_err", hi)]) / 2
    else:
        return df.sparkSession.createDataFrame(
            [(None,) * 6 + (0,)], "rmse double, mae double, r2 double, mape double, medae double, "
            "explained_variance double, n long")
    vy = row["vy"]
    r2 = 1 - row["mse"] / vy if vy else 0.0
    ev = 1 - row["ve"] / vy if vy else 0.0
    return df.sparkSession.createDataFrame(
        [(math.sqrt(row["mse"]), row["mae"], r2, row["mape"], medae, ev, n)],
        "rmse double, mae double, r2 double, mape double, medae double, "
        "explained_variance double, n long")


def residuals(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.col(prediction).cast("double").alias("prediction"),
                     (F.col(label).cast("double") - F.col(prediction).cast("double"))
                     .alias("residual"))


def prediction_vs_actual(df: DataFrame, label: str, prediction: str,
                         keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.col(label).cast("double").alias("actual"),
                     F.col(prediction).cast("double").alias("prediction"))


def diagnose(train_score: float, test_score: float) -> str:
    """Learning-curve diagnosis on the final (largest) training fraction."""
    gap = train_score - test_score
    if gap > 0.1 and train_score > 0.9:
        return "overfitting"
    if train_score < 0.7 and test_score < 0.7:
        return "underfitting"
    if gap > 0.15:
        return "high_variance"
    return "good_fit"
