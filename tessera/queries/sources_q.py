"""Source, sink and catalog queries (§2.1): write a driver table in each
format to a scratch folder under the cluster's checkpoint folder, read it
back through the dispatching reader, compare with the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import files
from ..sources import readers as R
from ..sources.catalog import Catalog
from . import query
from .tables import table

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ROUNDTRIP_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _scratch(spark, name: str) -> str:
    path = files.join(ensure_checkpoint_dir(spark), "scratch", f"{uuid.uuid4().hex[:8]}-{name}")
    files.drop_at_exit(spark, path)
    return path


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLS)


@query("read_csv", ROUNDTRIP_SQL)
def read_csv(spark, sf):
    path = _scratch(spark, "orders.csv")
    _orders(spark, sf).write.option("header", True).csv(path)
    return R.read_any(spark, path, "csv").select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
        F.col("o_totalprice").cast("double"), "o_orderpriority")


@query("read_tsv", ROUNDTRIP_SQL)
def read_tsv(spark, sf):
    path = _scratch(spark, "orders.tsv")
    _orders(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return R.read_any(spark, path, "tsv").select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
        F.col("o_totalprice").cast("double"), "o_orderpriority")


@query("read_json", ROUNDTRIP_SQL)
def read_json(spark, sf):
    path = _scratch(spark, "orders.json")
    _orders(spark, sf).write.json(path)
    return R.read_any(spark, path, "json").select(*ORDER_COLS)


@query("read_parquet", ROUNDTRIP_SQL)
def read_parquet(spark, sf):
    path = _scratch(spark, "orders.parquet")
    R.write_dataset(_orders(spark, sf), path)
    return R.read_any(spark, path).select(*ORDER_COLS)


@query("dataset_metadata", """SELECT 'customer.parquet' AS filename, count(*) AS rows,
  5 AS columns, 3 AS n_numeric, 2 AS n_categorical, 0 AS n_datetime FROM customer""")
def dataset_metadata(spark, sf):
    cat = Catalog(spark, _scratch(spark, "catalog"))
    meta = cat.register(table(spark, sf, "customer"), "customer.parquet")
    return spark.createDataFrame(
        [(meta["filename"], meta["rows"], meta["columns"], len(meta["numerical_columns"]),
          len(meta["categorical_columns"]), len(meta["datetime_columns"]))],
        "filename string, rows long, columns int, n_numeric int, n_categorical int, "
        "n_datetime int")


@query("catalog_roundtrip", "SELECT * FROM part")
def catalog_roundtrip(spark, sf):
    """Register, list, fetch, rebuild metadata; the stored dataset equals the input."""
    cat = Catalog(spark, _scratch(spark, "catalog"))
    meta = cat.register(table(spark, sf, "part"), "part.parquet")
    assert cat.list().where(F.col("dataset_id") == meta["dataset_id"]).count() == 1
    cat.rebuild(meta["dataset_id"])
    return cat.get(meta["dataset_id"])


@query("read_unknown_extension", ROUNDTRIP_SQL)
def read_unknown_extension(spark, sf):
    """A ``.txt`` folder of delimited text is tried as CSV."""
    path = _scratch(spark, "orders.txt")
    _orders(spark, sf).write.option("header", True).csv(path)
    return R.read_any(spark, path).select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
        F.col("o_totalprice").cast("double"), "o_orderpriority")
