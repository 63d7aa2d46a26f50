"""Dataset catalog: datasets are Parquet directories under a root folder, and
their metadata is a Parquet table next to them (one row per dataset).

Metadata is computed by Spark (schema + one ``count``) and can be rebuilt
from the data folders when the metadata table is lost.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import categorical_cols, datetime_cols, numeric_cols
from . import files
from .readers import read_any, write_dataset

META_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("columns", T.IntegerType()),
    T.StructField("column_names", T.ArrayType(T.StringType())),
    T.StructField("numerical_columns", T.ArrayType(T.StringType())),
    T.StructField("categorical_columns", T.ArrayType(T.StringType())),
    T.StructField("datetime_columns", T.ArrayType(T.StringType())),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("uploaded_at", T.StringType()),
])


def dataset_metadata(df: DataFrame, dataset_id: str, filename: str, path: str | None = None,
                     uploaded_at: str | None = None) -> dict:
    return {
        "dataset_id": dataset_id,
        "filename": filename,
        "rows": int(df.count()),
        "columns": len(df.columns),
        "column_names": list(df.columns),
        "numerical_columns": numeric_cols(df),
        "categorical_columns": categorical_cols(df),
        "datetime_columns": datetime_cols(df),
        "size_bytes": files.size(df.sparkSession, path) if path else 0,
        "uploaded_at": uploaded_at or _dt.datetime.now(_dt.timezone.utc).isoformat(),
    }


class Catalog:
    """Datasets under ``root/data/<id>``, metadata table under ``root/meta/<id>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        files.make_folder(spark, files.join(root, "data"))
        files.make_folder(spark, files.join(root, "meta"))

    def _data(self, dataset_id: str) -> str:
        return files.join(self.root, "data", dataset_id)

    def _meta(self, dataset_id: str) -> str:
        return files.join(self.root, "meta", dataset_id)

    def ingest(self, path: str, filename: str | None = None, format: str | None = None) -> dict:
        df = read_any(self.spark, path, format)
        return self.register(df, filename or path.rstrip("/").rsplit("/", 1)[-1])

    def register(self, df: DataFrame, filename: str) -> dict:
        dataset_id = uuid.uuid4().hex
        write_dataset(df, self._data(dataset_id))
        stored = self.spark.read.parquet(self._data(dataset_id))
        meta = dataset_metadata(stored, dataset_id, filename, self._data(dataset_id))
        self.spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(self._meta(dataset_id))
        return meta

    def list(self) -> DataFrame:
        ids = files.names(self.spark, files.join(self.root, "meta"))
        if not ids:
            return self.spark.createDataFrame([], META_SCHEMA)
        return self.spark.read.schema(META_SCHEMA).parquet(*[self._meta(i) for i in ids])

    def get(self, dataset_id: str) -> DataFrame | None:
        p = self._data(dataset_id)
        return self.spark.read.parquet(p) if files.exists(self.spark, p) else None

    def rebuild(self, dataset_id: str, filename: str | None = None) -> dict | None:
        """Recreate lost metadata from the stored data folder."""
        df = self.get(dataset_id)
        if df is None:
            return None
        meta = dataset_metadata(df, dataset_id, filename or f"{dataset_id}.parquet",
                                self._data(dataset_id))
        self.spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(self._meta(dataset_id))
        return meta

    def delete(self, dataset_id: str) -> bool:
        existed = False
        for p in (self._data(dataset_id), self._meta(dataset_id)):
            existed = files.delete(self.spark, p) or existed
        return existed
