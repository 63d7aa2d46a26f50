"""Evaluation queries on rule-made predictions over ``lineitem`` (§2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from . import query
from .tables import round_doubles, table

# Fixed fixtures: a multi-class rule, a binary label with a tied score, and a
# crude price rule for regression.  Same expressions in Spark and SQL.
MULTI_SQL = """(SELECT l_orderkey, l_linenumber, l_returnflag AS y,
  CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p
  FROM lineitem)"""
BIN_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_discount * 10 + l_tax AS s,
  CASE WHEN l_discount * 10 + l_tax > 0.5 THEN 1 ELSE 0 END AS p FROM lineitem)"""
REG_SQL = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS y,
  l_quantity * 1500.0 + 1000.0 AS p FROM lineitem)"""


def multi(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("y"),
                     F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("p"))


def binary(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.col("l_discount") * 10 + F.col("l_tax")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
                     s.alias("s"), F.when(s > 0.5, 1).otherwise(0).alias("p"))


def regression(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * 1500.0 + 1000.0).alias("p"))


def _cls_sql(src: str) -> str:
    return f"""WITH d AS {src},
cm AS (SELECT CAST(y AS VARCHAR) AS y, CAST(p AS VARCHAR) AS p, count(*) AS c FROM d GROUP BY 1, 2),
cls AS (SELECT y AS k FROM cm UNION SELECT p FROM cm),
t AS (SELECT k,
  coalesce((SELECT sum(c) FROM cm WHERE cm.y = cls.k), 0) AS tk,
  coalesce((SELECT sum(c) FROM cm WHERE cm.p = cls.k), 0) AS pk,
  coalesce((SELECT sum(c) FROM cm WHERE cm.y = cls.k AND cm.p = cls.k), 0) AS tp FROM cls),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n FROM cm)
SELECT round(sum(tp) / n, 6) AS accuracy,
  round(avg(CASE WHEN tk > 0 THEN tp / tk END), 6) AS balanced_accuracy,
  round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / pk) * (tp / tk) / ((tp / pk) + (tp / tk)) END), 6)
    AS f1_macro,
  round((sum(tp) * n - sum(tk * pk)) / sqrt((n * n - sum(pk * pk)) * (n * n - sum(tk * tk))), 6)
    AS mcc,
  round((sum(tp) / n - sum(tk * pk) / (n * n)) / (1 - sum(tk * pk) / (n * n)), 6) AS cohen_kappa,
  n FROM t, n GROUP BY n"""


@query("classification_metrics", _cls_sql(MULTI_SQL))
def classification_metrics(spark, sf):
    return round_doubles(EV.classification_metrics(multi(spark, sf), "y", "p"), 6)


@query("classification_metrics_binary", _cls_sql(BIN_SQL))
def classification_metrics_binary(spark, sf):
    return round_doubles(EV.classification_metrics(binary(spark, sf), "y", "p"), 6)


@query("classification_report", f"""WITH d AS {MULTI_SQL},
cm AS (SELECT y, p, count(*) AS c FROM d GROUP BY 1, 2),
cls AS (SELECT y AS k FROM cm UNION SELECT p FROM cm),
t AS (SELECT k,
  coalesce((SELECT sum(c) FROM cm WHERE cm.y = cls.k), 0) AS tk,
  coalesce((SELECT sum(c) FROM cm WHERE cm.p = cls.k), 0) AS pk,
  coalesce((SELECT sum(c) FROM cm WHERE cm.y = cls.k AND cm.p = cls.k), 0) AS tp FROM cls),
m AS (SELECT k, CASE WHEN pk > 0 THEN tp / pk ELSE 0 END AS pr,
  CASE WHEN tk > 0 THEN tp / tk ELSE 0 END AS re, tk FROM t),
f AS (SELECT k, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, tk FROM m)
SELECT k AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1,
  CAST(tk AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6),
  CAST(sum(tk) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * tk) / sum(tk), 6), round(sum(re * tk) / sum(tk), 6),
  round(sum(f1 * tk) / sum(tk), 6), CAST(sum(tk) AS BIGINT) FROM f""")
def classification_report(spark, sf):
    return round_doubles(EV.classification_report(multi(spark, sf), "y", "p"), 6)


@query("confusion_matrix", f"""WITH d AS {MULTI_SQL},
cm AS (SELECT y, p, count(*) AS c FROM d GROUP BY 1, 2),
cls AS (SELECT y AS k FROM cm UNION SELECT p FROM cm)
SELECT a.k AS label, b.k AS prediction, CAST(coalesce(cm.c, 0) AS BIGINT) AS count
FROM cls a CROSS JOIN cls b LEFT JOIN cm ON cm.y = a.k AND cm.p = b.k""")
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(multi(spark, sf), "y", "p")


@query("roc_auc", f"""WITH d AS {BIN_SQL},
r AS (SELECT y, rank() OVER (ORDER BY s) AS r0, count(*) OVER (PARTITION BY s) AS cnt FROM d),
c AS (SELECT sum(y) AS P, count(*) - sum(y) AS N FROM d)
SELECT round((sum(CASE WHEN y = 1 THEN r0 + (cnt - 1) / 2.0 END) - (SELECT P * (P + 1) / 2 FROM c))
  / (SELECT P * N FROM c), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf):
    auc = EV.roc_auc(binary(spark, sf), "y", "s")
    return spark.createDataFrame([(round(auc, 6),)], "roc_auc double")


@query("roc_curve", f"""WITH d AS {BIN_SQL},
st AS (SELECT s AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1)
SELECT threshold,
  round(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) / (SELECT sum(neg) FROM st), 6)
    AS fpr,
  round(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) / (SELECT sum(pos) FROM st), 6)
    AS tpr FROM st
UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_curve(spark, sf):
    return round_doubles(EV.roc_curve(binary(spark, sf), "y", "s"), 6)


@query("precision_recall_curve", f"""WITH d AS {BIN_SQL},
st AS (SELECT s AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1),
c AS (SELECT threshold,
  sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM st)
SELECT threshold, round(tp / (tp + fp), 6) AS precision,
  round(tp / (SELECT sum(pos) FROM st), 6) AS recall FROM c
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""")
def precision_recall_curve(spark, sf):
    return round_doubles(EV.precision_recall_curve(binary(spark, sf), "y", "s"), 6)


@query("regression_metrics", f"""WITH d AS {REG_SQL}
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2,
  round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape,
  round(quantile_cont(abs(y - p), 0.5), 4) AS medae,
  round(1 - var_pop(y - p) / var_pop(y), 4) AS explained_variance, count(*) AS n FROM d""")
def regression_metrics(spark, sf):
    return round_doubles(EV.regression_metrics(regression(spark, sf), "y", "p"), 4)


@query("residuals", f"""SELECT l_orderkey, l_linenumber, round(p, 4) AS prediction,
  round(y - p, 4) AS residual FROM {REG_SQL} d""")
def residuals(spark, sf):
    return round_doubles(EV.residuals(regression(spark, sf), "y", "p",
                                      ["l_orderkey", "l_linenumber"]), 4)


@query("prediction_vs_actual", f"""SELECT l_orderkey, l_linenumber, round(y, 4) AS actual,
  round(p, 4) AS prediction FROM {REG_SQL} d""")
def prediction_vs_actual(spark, sf):
    return round_doubles(EV.prediction_vs_actual(regression(spark, sf), "y", "p",
                                                 ["l_orderkey", "l_linenumber"]), 4)
