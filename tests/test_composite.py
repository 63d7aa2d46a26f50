"""Saved neighbours, votes and stacks predict as they did."""

import numpy as np
import pytest

from tessera.operators import learners as L
from tessera.sources.models import ModelStore


@pytest.mark.parametrize("kind,problem,params", [("knn", "classification", {"n_neighbors": 3, "weights": "distance"}),
                                                 ("knn", "regression", None), ("voting", "classification", None), ("stacking", "regression", None)])
def test_round_trip(spark, tmp_path, monkeypatch, kind, problem, params):
    made = L.make_estimator
    monkeypatch.setattr(L, "make_estimator", lambda t, p, q=None, *a, **k: made(t, p, {"n_estimators": 3} if L.canonical(t) in (
        "random_forest", "gradient_boosting") else q, *a, **k))
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 2))
    y = (x[:, 0] > 0).astype(int) if problem == "classification" else x @ [1.0, 2.0]
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    if problem == "classification":
        df = df.withColumn("y", df.y.cast("int"))
    d, classes = L.prepare_label(df, "y", problem)
    model = L._fit_one(d.withColumn("_row_key", d.id), ["a", "b"], kind, problem, params, len(classes or []), 42)
    store = ModelStore(spark, f"{tmp_path}/models")
    again, meta = store.load(store.save(model, kind, problem, ["a", "b"], "y", params))
    assert meta["model_type"] == kind

    def out(m):
        return sorted((w["id"], w["prediction"], tuple(w["class_probabilities"] or ())) for w in L.predict(m, df, classes).collect())
    a, b = out(model), out(again)
    assert [(i, round(p, 9)) for i, p, _ in a] == [(i, round(p, 9)) for i, p, _ in b]
    if problem == "classification":
        assert all(len(s) == 2 and abs(sum(s) - 1) < 1e-9 for _, _, s in a) and np.allclose([s for *_, s in a], [s for *_, s in b])


def test_other_objects_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        ModelStore(spark, f"{tmp_path}/models").save(object(), "x", "classification", [], "y")
