"""Recursive lag-feature forecaster pooled over all series (re-aim of the
single-series neural forecaster: no neural network).

Each series is min-max scaled; lag features 1..L come from one explode +
``groupBy`` (no window over a whole series); one ``pyspark.ml``
``LinearRegression`` is fitted on the rows of all series; the recursive
h-step forecast is one ``aggregate`` fold per series inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import indexed


def forecast_lag_model(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
                       horizon: int = 10, max_lookback: int = 10) -> DataFrame:
    user_by = list(by)
    # a constant group key stands in for "one series" so every join is an
    # equi-join on the series key (never a cartesian product)
    by = user_by or ["_g"]
    src = df if user_by else df.withColumn("_g", F.lit(0))
    idx = indexed(src, order, value, by).withColumn("_v", F.col(value).cast("double"))
    st = idx.groupBy(*by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                              F.first("_n").alias("_n"))
    L = max(1, int(max_lookback))
    # a series of fewer than two lookbacks neither trains nor is forecast; it says so
    least = max(2 * L, horizon + 2)
    short = st.where(F.col("_n") < least).select(
        *user_by, F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("forecast"),
        F.lit("too_short").alias("status"))
    st = st.where(F.col("_n") >= least)
    if st.isEmpty():
        return short
    sc = idx.join(st.drop("_n"), by, "inner")
    rng = F.when(F.col("_mx") > F.col("_mn"), F.col("_mx") - F.col("_mn")).otherwise(F.lit(1.0))
    sc = sc.withColumn("_s", (F.col("_v") - F.col("_mn")) / rng)
    # lag j of row i is the value at i - j: emit every value to rows i+1 .. i+L
    em = sc.select(*by, F.explode(F.sequence(F.lit(0), F.lit(L))).alias("_j"), "_i", "_s") \
        .select(*by, (F.col("_i") + F.col("_j")).alias("_i"), "_j", "_s")
    feats = em.groupBy(*by, "_i").agg(*[F.max(F.when(F.col("_j") == j, F.col("_s")))
                                        .alias(f"lag_{j}") for j in range(L + 1)])
    train = feats.where(F.col("_i") >= L).na.drop()
    va = VectorAssembler(inputCols=[f"lag_{j}" for j in range(1, L + 1)], outputCol="_x")
    model = LinearRegression(featuresCol="_x", labelCol="lag_0", regParam=0.0).fit(
        va.transform(train))
    coef = [float(c) for c in model.coefficients]
    icpt = float(model.intercept)
    # last L scaled values per series (oldest first) → fold h steps in the JVM
    last = feats.join(st, by, "inner")
    last = last.where(F.col("_i") == F.col("_n") - 1)
    window = F.array(*[F.col(f"lag_{j}") for j in range(L - 1, -1, -1)])  # oldest .. newest

    def step(acc, _):
        w = acc["w"]
        pred = F.lit(icpt)
        for j in range(1, L + 1):
            pred = pred + F.lit(coef[j - 1]) * F.element_at(w, -j)
        return F.struct(F.concat(F.slice(w, 2, L), F.array(pred)).alias("w"),
                        F.concat(acc["p"], F.array(pred)).alias("p"))

    init = F.struct(window.alias("w"), F.array().cast("array<double>").alias("p"))
    folded = last.select(*by, "_mn", "_mx", "_n", F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), init, step).alias("_acc"))
    rng2 = F.when(F.col("_mx") > F.col("_mn"), F.col("_mx") - F.col("_mn")).otherwise(F.lit(1.0))
    out = folded.select(*by, "_mn", rng2.alias("_r"), F.posexplode("_acc.p").alias("_k", "_p"))
    return out.select(*user_by, (F.col("_k") + 1).alias("step"),
                      (F.col("_p") * F.col("_r") + F.col("_mn")).alias("forecast"),
                      F.lit("ok").alias("status")).unionAll(short)
