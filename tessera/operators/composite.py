"""Saving and loading models that are more than one pipeline: nearest neighbours with their
table, votes and stacks with their members.

A composite model is a folder with a one-row table ``spec`` (its kind and settings, as JSON)
and its parts, each a saved pipeline, a table or a composite of its own.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..sources import files
from .learners import Ensemble
from .neighbors import KNNModel


def save(spark: SparkSession, model, path: str) -> None:
    """Writes ``model`` under ``path``, replacing what is there."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return
    files.delete(spark, path)
    if isinstance(model, KNNModel):
        spec = {"kind": "knn", "features": model.features, "k": model.k, "weights": model.weights, "problem": model.problem,
                "n_classes": model.n_classes}
        model.train.write.parquet(files.join(path, "train"))
    elif isinstance(model, Ensemble):
        spec = {"kind": model.kind, "problem": model.problem, "voting": model.voting, "n_classes": model.n_classes,
                "bases": len(model.bases), "final": model.final is not None}
        for i, base in enumerate(model.bases):
            save(spark, base, files.join(path, f"base-{i}"))
        if model.final is not None:
            save(spark, model.final, files.join(path, "final"))
    else:
        raise TypeError(f"{type(model).__name__} cannot be saved")
    # last, so that a folder with a spec is whole
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.parquet(files.join(path, "spec"))


def load(spark: SparkSession, path: str):
    """The model saved under ``path``."""
    if not files.exists(spark, files.join(path, "spec")):
        return PipelineModel.load(path)
    spec = json.loads(spark.read.parquet(files.join(path, "spec")).first()["spec"])
    if spec["kind"] == "knn":
        model = KNNModel(spec["features"], spec["k"], spec["weights"], spec["problem"], spec["n_classes"])
        model.train = spark.read.parquet(files.join(path, "train"))
        return model
    bases = [load(spark, files.join(path, f"base-{i}")) for i in range(spec["bases"])]
    final = load(spark, files.join(path, "final")) if spec["final"] else None
    return Ensemble(spec["kind"], bases, spec["problem"], final=final, voting=spec["voting"], n_classes=spec["n_classes"])
