"""Trees grown from cells are those of the rows; cells do not grow with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import binning as B
from tessera.operators import learners as L
from tessera.operators import tune as TU


def frame(spark, n=1500, classes=3, copies=1):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 50, n), r.normal(size=n)
    y = (a + 10 * b + r.normal(scale=8, size=n))
    rows = [(i, float(u), float(v), int(np.clip(t // 20, 0, classes - 1)), float(t)) for i, (u, v, t) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, t double")
    return df if copies == 1 else df.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("c")


@pytest.mark.parametrize("model,params", [("decision_tree", {"max_depth": 6, "min_samples_leaf": 4}), ("gradient_boosting", {"n_estimators": 4, "max_depth": 3})])
@pytest.mark.parametrize("problem,label", [("classification", "y"), ("regression", "t")])
def test_same_trees_as_from_rows(spark, model, params, problem, label):
    d, classes = L.prepare_label(frame(spark, classes=2), label, problem)
    n = len(classes or [])
    plain = L.build_pipeline(["a", "b"], model, problem, params, n).fit(d)
    ours = L._fit_pipeline(d, ["a", "b"], model, problem, params, n)
    get = lambda m: {r["id"]: r["prediction"] for r in m.transform(d).select("id", "prediction").collect()}
    want, got = get(plain), get(ours)
    assert all(abs(want[i] - got[i]) < 1e-6 for i in want)


def test_cells_count_every_row_and_do_not_grow(spark):
    one = L.feature_cells(L.prepare_label(frame(spark), "y", "classification")[0], ["a", "b"], "classification")
    ten = L.feature_cells(L.prepare_label(frame(spark, copies=10), "y", "classification")[0], ["a", "b"], "classification")
    assert one.n_rows == 1500 and ten.n_rows == 15000 and one.n_cells == ten.n_cells <= 32 * 32 * 3


def test_many_values_constants_and_odd_numbers(spark, monkeypatch):
    monkeypatch.setattr(B, "MANY", 100)
    df = spark.createDataFrame([(float(i), 7.0, [float("nan"), float("-inf"), float("inf"), 1.0, 2.0][i % 5], float(i % 5)) for i in range(1000)],
                               "x double, k double, o double, y double")
    found = B.thresholds(df, ["x", "k", "o"], 8)
    assert len(found["x"]) == 7 and np.allclose(found["x"], [125 * i for i in range(1, 8)], atol=1) and found["k"] == []
    made = B.cells(df, ["x", "k", "o"], "y", True, 8)
    assert made.n_rows == 1000
    seen = {r["y"]: r["_x_b2"] for r in made.rows.select("y", "_x_b2").distinct().collect()}
    assert seen[1.0] < seen[3.0] < seen[4.0] < seen[0.0] and seen[2.0] <= seen[0.0]


def test_search_counts_cells_once_a_fold(spark, monkeypatch):
    calls = []
    made = L.feature_cells
    monkeypatch.setattr(L, "feature_cells", lambda *a, **k: calls.append(1) or made(*a, **k))
    _, best, trials = TU.search(frame(spark, 300), ["a", "b"], "y", "decision_tree", "classification", "id", "grid", k=2,
                                space={"max_depth": [2, 4], "min_samples_leaf": [1, 3]})
    assert len(calls) == 2 and trials.count() == 4 and trials.where("error is not null").count() == 0 and best > 0.5
