"""The preparation workflow end to end, fitted on all rows and on the training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.workflow import run_pipeline
from . import query
from .tables import CUSTOMER_GAPS_SQL, customer_gaps, round_doubles, table, unpivot


def _scaled(c: str, fit: str) -> str:
    return (f"(d.{c} - (SELECT avg({c}) FROM {fit})) / (SELECT CASE WHEN stddev_pop({c}) = 0 "
            f"THEN 1 ELSE stddev_pop({c}) END FROM {fit})")


@query("run_pipeline_all", f"""WITH g AS {CUSTOMER_GAPS_SQL},
md AS (SELECT c_mktsegment AS v FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1),
imp AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM g)) AS c_acctbal, c_nationkey,
  coalesce(c_mktsegment, (SELECT v FROM md)) AS c_mktsegment FROM g),
sp AS (SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <=
  floor((SELECT count(*) FROM g) * 0.8) THEN 'train' ELSE 'test' END AS split FROM g),
nf AS (SELECT DISTINCT c_mktsegment AS v FROM imp WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM imp))
SELECT c_custkey, split, 'c_acctbal' AS feature, round({_scaled('c_acctbal', 'imp')}, 4) AS value
  FROM imp d JOIN sp USING (c_custkey)
UNION ALL SELECT c_custkey, split, 'c_nationkey', round({_scaled('c_nationkey', 'imp')}, 4)
  FROM imp d JOIN sp USING (c_custkey)
UNION ALL SELECT c_custkey, split, 'c_mktsegment_' || v, CAST(CASE WHEN c_mktsegment = v THEN 1 ELSE 0 END AS DOUBLE)
  FROM imp JOIN sp USING (c_custkey), nf""")
def run_pipeline_all(spark, sf):
    got = run_pipeline(customer_gaps(spark, sf).drop("c_nation"), "c_custkey", scaling="standard",
                       categorical=["c_mktsegment"])
    return round_doubles(unpivot(got.data, ["c_custkey", "split"], got.features), 4)


LINE_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS li_key, CASE WHEN l_orderkey % 11 = 0 THEN NULL
  ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount FROM lineitem)"""


@query("run_pipeline_train", f"""WITH g AS {LINE_SQL},
sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY li_key) <= floor((SELECT count(*) FROM g) * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM g),
t AS (SELECT * FROM sp WHERE split = 'train'),
imp AS (SELECT li_key, split, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity,
  l_extendedprice, l_discount FROM sp),
f AS (SELECT * FROM imp WHERE split = 'train')
SELECT li_key, split, 'l_quantity' AS feature,
  round((l_quantity - (SELECT min(l_quantity) FROM f)) / (SELECT max(l_quantity) - min(l_quantity) FROM f), 6) AS value FROM imp
UNION ALL SELECT li_key, split, 'l_extendedprice',
  round((l_extendedprice - (SELECT min(l_extendedprice) FROM f)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM f), 6) FROM imp
UNION ALL SELECT li_key, split, 'l_discount',
  round((l_discount - (SELECT min(l_discount) FROM f)) / (SELECT max(l_discount) - min(l_discount) FROM f), 6) FROM imp""")
def run_pipeline_train(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("li_key"),
        F.when(F.col("l_orderkey") % 11 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount")
    got = run_pipeline(li, "li_key", imputation="median", scaling="minmax", fit_on="train")
    return round_doubles(unpivot(got.data, ["li_key", "split"], got.features), 6)
