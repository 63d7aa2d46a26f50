"""Model store: fitted models (pipelines, neighbours, votes and stacks) plus a metadata row each
(model type, problem type, feature names, hyper-parameters, metrics)."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import files

MODEL_META_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("problem_type", T.StringType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("label", T.StringType()),
    T.StructField("params_json", T.StringType()),
    T.StructField("metrics_json", T.StringType()),
    T.StructField("created_at", T.StringType()),
])


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        files.make_folder(spark, root)

    def _dir(self, model_id: str) -> str:
        return files.join(self.root, model_id)

    def save(self, model, model_type: str, problem_type: str,
             feature_names: list[str], label: str, params: dict | None = None,
             metrics: dict | None = None, model_id: str | None = None) -> str:
        from ..operators import composite
        model_id = model_id or uuid.uuid4().hex
        composite.save(self.spark, model, files.join(self._dir(model_id), "model"))
        meta = {"model_id": model_id, "model_type": model_type, "problem_type": problem_type,
                "feature_names": list(feature_names), "label": label,
                "params_json": json.dumps(params or {}, default=str, sort_keys=True),
                "metrics_json": json.dumps(metrics or {}, default=str, sort_keys=True),
                "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat()}
        self.spark.createDataFrame([meta], MODEL_META_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(files.join(self._dir(model_id), "meta"))
        return model_id

    def load(self, model_id: str) -> tuple:
        from ..operators import composite
        model = composite.load(self.spark, files.join(self._dir(model_id), "model"))
        meta = self.spark.read.parquet(files.join(self._dir(model_id), "meta")).first().asDict()
        return model, meta

    def list(self) -> DataFrame:
        ids = [d for d in files.names(self.spark, self.root)
               if files.exists(self.spark, files.join(self._dir(d), "meta"))]
        if not ids:
            return self.spark.createDataFrame([], MODEL_META_SCHEMA)
        return self.spark.read.schema(MODEL_META_SCHEMA).parquet(
            *[files.join(self._dir(i), "meta") for i in ids])

    def delete(self, model_id: str) -> bool:
        return files.delete(self.spark, self._dir(model_id))
