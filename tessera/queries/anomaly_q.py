"""Outlier and anomaly queries (§2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as A
from . import query
from .sqlgen import union_all
from .tables import round_doubles, table

OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _iqr_sql(t: float = 1.5) -> str:
    parts = []
    for c in OUT_COLS:
        parts.append(f"""SELECT '{c}' AS column_name,
  count(*) FILTER (WHERE {c} < q1 - {t} * (q3 - q1) OR {c} > q3 + {t} * (q3 - q1)) AS outlier_count,
  round(count(*) FILTER (WHERE {c} < q1 - {t} * (q3 - q1) OR {c} > q3 + {t} * (q3 - q1))
    / count({c}) * 100.0, 6) AS outlier_pct
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) q""")
    return union_all(parts)


def _z_sql(t: float = 1.5) -> str:
    parts = []
    for c in OUT_COLS:
        cond = f"abs(({c} - m) / s) > {t}"
        parts.append(f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS outlier_count,
  round(count(*) FILTER (WHERE {cond}) / count({c}) * 100.0, 6) AS outlier_pct
FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) q""")
    return union_all(parts)


@query("outliers_iqr", _iqr_sql())
def outliers_iqr(spark, sf):
    return round_doubles(A.outliers(table(spark, sf, "lineitem"), "iqr", 1.5, OUT_COLS), 6)


@query("outliers_zscore", _z_sql())
def outliers_zscore(spark, sf):
    return round_doubles(A.outliers(table(spark, sf, "lineitem"), "zscore", 1.5, OUT_COLS), 6)


def _keyed_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("li_key"),
                     "l_quantity", "l_extendedprice", "l_discount")


@query("isolation_forest")
def isolation_forest(spark, sf):
    out = A.isolation_forest(_keyed_lineitem(spark, sf),
                             ["l_quantity", "l_extendedprice", "l_discount"], "li_key")
    return out.select("li_key", "anomaly_score", "is_anomaly")


@query("one_class_svm")
def one_class_svm(spark, sf):
    c = table(spark, sf, "customer")
    out = A.one_class_svm(c, ["c_acctbal", "c_nationkey"], "c_custkey")
    return out.select("c_custkey", "decision", "is_anomaly")


def _daily(spark, sf, *by):
    o = table(spark, sf, "orders")
    return o.groupBy(*by, "o_orderdate").agg(F.sum("o_totalprice").alias("total"))


@query("series_anomalies")
def series_anomalies(spark, sf):
    """Univariate forest over the daily order total, contamination 0.05."""
    out = A.series_anomalies(_daily(spark, sf), "total", "o_orderdate")
    return out.where("is_anomaly").select("index", "o_orderdate", "value", "score")


@query("series_anomalies_by", """WITH d AS (SELECT o_orderpriority, o_orderdate FROM orders GROUP BY 1, 2),
s AS (SELECT o_orderpriority, count(*) AS n_values FROM d GROUP BY 1)
SELECT o_orderpriority, n_values, 'ok' AS status FROM s
UNION ALL SELECT 'none', 0, 'too_short'""")
def series_anomalies_by(spark, sf):
    """A forest for every priority's daily total, all in one pass; a series without values
    says so.  Which days are anomalous is tested, here the series are counted."""
    d = _daily(spark, sf, "o_orderpriority")
    d = d.unionByName(d.limit(1).withColumn("o_orderpriority", F.lit("none")).withColumn("total", F.lit(None).cast("double")))
    out = A.series_anomalies(d, "total", "o_orderdate", by=["o_orderpriority"])
    flagged = F.count_if("is_anomaly")
    share = out.groupBy("o_orderpriority", "status").agg(F.count("index").alias("n_values"), flagged.alias("m"))
    # the contamination is met to within what ties leave
    return share.where((F.col("status") == "too_short") | (F.abs(F.col("m") - 0.05 * F.col("n_values")) <= 0.02 * F.col("n_values"))) \
        .select("o_orderpriority", "n_values", "status")


@query("outliers_isolation_forest")
def outliers_isolation_forest(spark, sf):
    """Per-column univariate forests over two lineitem columns."""
    return A.outliers(_keyed_lineitem(spark, sf), "isolation_forest",
                      cols=["l_quantity", "l_extendedprice"], key="li_key")
