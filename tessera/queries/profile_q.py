"""Profiling queries (§2.2)."""

from __future__ import annotations

from ..operators import profile as P
from . import query
from .sqlgen import nearest, union_all
from .tables import ORDERS_GAPS_SQL, orders_gaps, table

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
ORDERS_GAPS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    "o_orderpriority", "o_rebate"]
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HIST_COLS = ["l_quantity", "l_extendedprice"]


def _describe_sql() -> str:
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, "
            f"count(*) - count({x}) AS null_count, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, "
            f"round({nearest(x, 0.25)}, 4) AS p25, round({nearest(x, 0.5)}, 4) AS p50, "
            f"round({nearest(x, 0.75)}, 4) AS p75, round(max({x}), 4) AS max FROM lineitem")
    return union_all(parts)


@query("describe_numeric", _describe_sql())
def describe_numeric(spark, sf):
    return P.describe_numeric(table(spark, sf, "lineitem"), LINEITEM_NUM)


def _describe_cat_sql() -> str:
    arms = union_all([f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt "
                      f"FROM customer GROUP BY {c}" for c in ("c_name", "c_mktsegment")])
    return f"""WITH vc AS ({arms}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM vc)
SELECT column_name, count(*) AS n_unique, max(CASE WHEN rn = 1 THEN value END) AS top,
       max(cnt) AS freq FROM r GROUP BY column_name"""


@query("describe_categorical", _describe_cat_sql())
def describe_categorical(spark, sf):
    return P.describe_categorical(table(spark, sf, "customer"))


def _missing_sql() -> str:
    return union_all([
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"round((count(*) - count({c})) / greatest(count(*), 1) * 100.0, 2) AS null_pct "
        f"FROM {ORDERS_GAPS_SQL} g" for c in ORDERS_GAPS_COLS])


@query("missing_report", _missing_sql())
def missing_report(spark, sf):
    return P.missing_report(orders_gaps(spark, sf))


SHAPE_SQL = """SELECT CAST(ordinal_position AS INTEGER) AS position, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END
    AS dtype,
  (SELECT count(*) FROM orders) AS n_rows,
  CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS INTEGER)
    AS n_cols
FROM information_schema.columns WHERE table_name = 'orders'"""


@query("shape_and_dtypes", SHAPE_SQL)
def shape_and_dtypes(spark, sf):
    return P.shape_and_dtypes(table(spark, sf, "orders"))


PAGE_SQL = """SELECT *, (SELECT count(*) FROM orders) AS total_rows,
  CAST(((SELECT count(*) FROM orders) + 49) // 50 AS BIGINT) AS total_pages
FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100"""


@query("page", PAGE_SQL)
def page(spark, sf):
    return P.page(table(spark, sf, "orders"), "o_orderkey", page_no=3, size=50)


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            r = f"corr({a}, {b})"
            expr = f"round(CASE WHEN {r} IS NULL OR isnan({r}) OR isinf({r}) THEN 0.0 ELSE {r} END, 4)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {expr} AS r FROM lineitem")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {expr} AS r FROM lineitem")
    return union_all(parts)


@query("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf):
    return P.correlation_matrix(table(spark, sf, "lineitem"), CORR_COLS)


def _infer_sql() -> str:
    spark_types = {"c_custkey": ("bigint", "integer"), "c_name": ("string", None),
                   "c_nationkey": ("int", "integer"), "c_acctbal": ("double", "float"),
                   "c_mktsegment": ("string", None)}
    parts = []
    for c, (st, lt) in spark_types.items():
        if lt is None:
            lt_sql = (f"CASE WHEN count({c}) > 0 AND count(TRY_CAST({c} AS TIMESTAMP)) = count({c}) "
                      f"THEN 'datetime' WHEN count(DISTINCT {c}) / count(*) < 0.5 "
                      f"THEN 'categorical' ELSE 'text' END")
        else:
            lt_sql = f"'{lt}'"
        parts.append(
            f"SELECT '{c}' AS column_name, '{st}' AS storage_type, {lt_sql} AS logical_type, "
            f"count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) / count(*) * 100.0, 4) AS missing_pct, "
            f"count(DISTINCT {c}) AS unique_count FROM customer")
    return union_all(parts)


@query("infer_types", _infer_sql())
def infer_types(spark, sf):
    return P.infer_types(table(spark, sf, "customer"), with_samples=False)


def _hist_sql() -> str:
    parts = []
    for c in HIST_COLS:
        parts.append(f"""SELECT column_name, CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / 10), 4) AS lower,
  round(lo + bin * ((hi - lo) / 10), 4) AS upper, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM (SELECT '{c}' AS column_name, min({c}) AS lo, max({c}) AS hi FROM lineitem) b
CROSS JOIN range(1, 11) t(bin)
LEFT JOIN (SELECT CAST(CASE WHEN mx = mn THEN 1
     ELSE least(CAST(floor(({c} - mn) / (mx - mn) * 10) AS INTEGER) + 1, 10) END AS INTEGER) AS b2,
     count(*) AS cnt
   FROM lineitem, (SELECT min({c}) AS mn, max({c}) AS mx FROM lineitem) s GROUP BY 1) c
ON c.b2 = t.bin""")
    return union_all(parts)


@query("distribution_histogram", _hist_sql())
def distribution_histogram(spark, sf):
    return P.distribution_histogram(table(spark, sf, "lineitem"), HIST_COLS, bins=10)


DUP_SQL = """SELECT count(*) AS n_rows,
  (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_distinct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents))
    AS n_duplicates
FROM documents"""


@query("duplicate_rows", DUP_SQL)
def duplicate_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents").select("text", "lang", "source"))
