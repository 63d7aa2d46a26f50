"""Driver tables and the derived views the queries share (same in Spark and SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with nulls injected deterministically by key (no column of the
    driver tables has a null) plus a mostly-null column."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 13 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 3 == 0, F.col("o_totalprice") / 100).alias("o_rebate"))


ORDERS_GAPS_SQL = """(SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100 END AS o_rebate
 FROM orders)"""


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (engines differ in the last bits of sums)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def unpivot(df: DataFrame, keys: list[str], cols: list[str], value_type: str = "double") -> DataFrame:
    """Wide → long ``(keys..., feature, value)``."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value"))
                    for c in cols])
    return df.select(*keys, F.inline(arr))


def customer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` with nulls injected by key, nation as a category."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        F.when(k % 9 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.when(k % 10 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("c_nation"))


CUSTOMER_GAPS_SQL = """(SELECT c_custkey,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  'N' || CAST(c_nationkey AS VARCHAR) AS c_nation
 FROM customer)"""
