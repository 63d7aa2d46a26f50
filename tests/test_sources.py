"""Catalog and model store round trips (list, get, rebuild, delete)."""

import os
import tempfile

from tessera.operators import learners as L
from tessera.sources.catalog import Catalog
from tessera.sources.models import ModelStore


def test_catalog_lifecycle(spark):
    root = tempfile.mkdtemp(prefix="tessera-cat-")
    cat = Catalog(spark, "file:" + root)
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "id long, s string, x double")
    meta = cat.register(df, "t.parquet")
    assert meta["rows"] == 2 and meta["numerical_columns"] == ["id", "x"]
    assert meta["categorical_columns"] == ["s"]
    assert cat.list().count() == 1
    assert cat.get(meta["dataset_id"]).count() == 2
    assert cat.rebuild(meta["dataset_id"])["columns"] == 3
    assert cat.delete(meta["dataset_id"]) is True
    assert cat.get(meta["dataset_id"]) is None and cat.list().count() == 0


def test_model_store_lifecycle(spark):
    root = tempfile.mkdtemp(prefix="tessera-models-")
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "id long, a double, y int")
    model, metrics, _, _ = L.train(df, ["a"], "y", "decision_tree", "classification", key="id")
    store = ModelStore(spark, root)
    mid = store.save(model, "decision_tree", "classification", ["a"], "y", {"max_depth": 5}, metrics)
    loaded, meta = store.load(mid)
    assert meta["feature_names"] == ["a"] and meta["model_type"] == "decision_tree"
    assert loaded.transform(df.withColumn("_label", df["y"].cast("double"))).count() == 60
    assert store.list().count() == 1
    assert store.delete(mid) and store.list().count() == 0
    assert not os.path.exists(os.path.join(root, mid))
