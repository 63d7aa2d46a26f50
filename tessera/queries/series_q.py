"""Time-series queries over daily order totals (§2.17) and regularisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as SR
from . import query
from .tables import round_doubles, table

DAILY_SQL = """(SELECT o_orderpriority, o_orderdate, sum(o_totalprice) AS total FROM orders
  GROUP BY 1, 2)"""
H = 10


def daily(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority", "o_orderdate").agg(F.sum("o_totalprice").alias("total"))


def _forecast_sql(method: str) -> str:
    expr = {"naive": "last", "mean": "mean", "moving_avg": "ma",
            "linear": "icpt + slope * (n + step - 1)", "drift": "icpt + slope * (n + step)"}[method]
    return f"""WITH d AS {DAILY_SQL},
i AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS i,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM d),
s AS (SELECT o_orderpriority, any_value(n) AS n, arg_max(total, i) AS last, avg(total) AS mean,
  avg(total) FILTER (WHERE i >= n - least(n, 5)) AS ma, regr_slope(total, i) AS slope,
  regr_intercept(total, i) AS icpt FROM i GROUP BY 1)
SELECT o_orderpriority, CAST(step AS INTEGER) AS step, round({expr}, 4) AS forecast, 'ok' AS status
FROM s, range(1, {H + 1}) t(step) WHERE n >= {H + 2}
UNION ALL SELECT o_orderpriority, NULL, NULL, 'too_short' FROM s WHERE n < {H + 2}"""


def _fc(method):
    def fn(spark, sf):
        return round_doubles(SR.forecast(daily(spark, sf), ["o_orderdate"], "total",
                                         ["o_orderpriority"], H, method), 4)
    return fn


for _m in ("naive", "mean", "moving_avg", "linear", "drift"):
    query(f"forecast_{_m}", _forecast_sql(_m))(_fc(_m))

for _m in ("arima", "sarima", "prophet", "lag_model"):
    query(f"forecast_{_m}")(_fc(_m))


@query("series_profile", f"""SELECT o_orderpriority, count(total) AS n, round(avg(total), 4) AS mean,
  round(stddev_samp(total), 4) AS std, round(min(total), 4) AS min, round(max(total), 4) AS max
FROM {DAILY_SQL} d GROUP BY 1""")
def series_profile(spark, sf):
    return round_doubles(SR.series_profile(daily(spark, sf), "total", ["o_orderpriority"]), 4)


@query("rolling_bounds", f"""WITH d AS {DAILY_SQL},
w AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rn,
  avg(total) OVER x AS m, stddev_samp(total) OVER x AS s FROM d
  WINDOW x AS (PARTITION BY o_orderpriority ORDER BY o_orderdate
    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT o_orderpriority, o_orderdate, round(total, 4) AS total,
  round(CASE WHEN rn >= 7 THEN m END, 4) AS roll_mean,
  round(CASE WHEN rn >= 7 THEN m - 2 * s END, 4) AS lower,
  round(CASE WHEN rn >= 7 THEN m + 2 * s END, 4) AS upper,
  (total < CASE WHEN rn >= 7 THEN m - 2 * s END) OR (total > CASE WHEN rn >= 7 THEN m + 2 * s END)
    AS outside FROM w""")
def rolling_bounds(spark, sf):
    return round_doubles(SR.rolling_bounds(daily(spark, sf), ["o_orderdate"], "total",
                                           ["o_orderpriority"], window=7, k=2.0), 4)


@query("regularize", """WITH d AS (SELECT o_custkey, o_orderkey,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS p, o_orderdate AS t, o_totalprice FROM orders),
l AS (SELECT o_custkey, p, o_totalprice AS v FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey, p ORDER BY t DESC, o_orderkey DESC) AS rn FROM d) WHERE rn = 1),
sp AS (SELECT o_custkey, min(p) AS lo, max(p) AS hi FROM d GROUP BY 1),
g AS (SELECT o_custkey, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS p
  FROM sp),
j AS (SELECT g.o_custkey, g.p, l.v FROM g LEFT JOIN l ON g.o_custkey = l.o_custkey AND g.p = l.p)
SELECT o_custkey, p AS o_orderdate, round(coalesce(
  last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY p
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY p
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS o_totalprice FROM j""")
def regularize(spark, sf):
    o = table(spark, sf, "orders")
    return round_doubles(SR.regularize(o, "o_orderdate", ["o_totalprice"], by=["o_custkey"],
                                       freq="M", tiebreak=["o_orderkey"]), 4)


@query("detect_date_column", """SELECT CASE
  WHEN count(TRY_CAST(event_type AS TIMESTAMP)) = count(event_type) THEN 'event_type'
  WHEN count(TRY_CAST(props AS TIMESTAMP)) = count(props) THEN 'props'
  WHEN count(TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP)) = count(ts) THEN 'ts_text'
  END AS date_column FROM events""")
def detect_date_column(spark, sf):
    e = table(spark, sf, "events").select("event_type", "props",
                                          F.col("ts").cast("string").alias("ts_text"), "user_id")
    return spark.createDataFrame([(SR.detect_date_column(e),)], "date_column string")


@query("adf_test")
def adf_test(spark, sf):
    return SR.adf_test(daily(spark, sf), ["o_orderdate"], "total", ["o_orderpriority"])
