"""The preparation workflow and the learners on the usual scenarios."""

import numpy as np
import pytest

from tessera.operators import learners as L
from tessera.operators.advise import auto_configure
from tessera.operators.workflow import run_pipeline


def frame(spark, cols):
    names = list(cols)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*cols.values())]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["id", *names])


def test_auto_configuration_of_a_skewed_imbalanced_table(spark):
    r = np.random.default_rng(42)
    df = frame(spark, {"skewed": r.exponential(10, 200), "normal": r.normal(size=200),
                       "category": r.choice(["A", "B", "C"], 200), "target": np.array([1] * 20 + [0] * 180)})
    got = auto_configure(df.drop("id"), "target", "Classification")
    assert got["scaling_method"] in ("robust", "power") and got["imbalance_handling"]["method"] == "smote"


@pytest.mark.parametrize("fit_on", ["all", "train"])
def test_classification_flow(spark, fit_on):
    r = np.random.default_rng(1)
    f1, f2 = r.normal(size=300), r.normal(size=300)
    df = frame(spark, {"f1": f1, "f2": f2, "f3": r.uniform(0, 10, 300), "cat": r.choice(["low", "med", "high"], 300),
                       "y": (2 * f1 + f2 > 0).astype(int)})
    got = run_pipeline(df, "id", "y", "Classification", scaling="standard", fit_on=fit_on)
    assert got.sizes() == {"n_train": 240, "n_test": 60, "n_features": 5}
    assert [s.split("=")[0] for s in got.steps] == ["imputation", "scaling", "encoding", "split"]
    if fit_on == "train":
        m = got.train.agg({"f1": "avg"}).first()[0]
        assert abs(m) < 1e-9
    model, metrics, _, classes = L.train(got.data, got.features, "y", "random_forest", "classification",
                                         {"n_estimators": 20}, key="id")
    assert metrics["accuracy"] > 0.70
    p = L.predict(model, got.test, classes).first()
    assert abs(sum(p["class_probabilities"]) - 1) < 1e-9 and len(p["class_probabilities"]) == 2


def test_imbalanced_rows_are_balanced_in_training_only(spark):
    r = np.random.default_rng(2)
    df = frame(spark, {**{f"c{i}": r.normal(size=150) for i in range(4)}, "y": np.array([1] * 10 + [0] * 140)})
    got = run_pipeline(df, "id", "y", "Classification", scaling="none", balancing={"method": "smote"})
    assert got.classes_before == {1: 8, 0: 112} and got.classes_after[1] == got.classes_after[0] == 112
    assert got.test.count() == 30 and got.steps[-1] == "imbalance_handling=smote"


def test_small_table_with_a_single_row_class(spark):
    df = frame(spark, {"a": np.arange(30.0), "y": np.array([1] + [0] * 29)})
    got = run_pipeline(df, "id", "y", "Classification")
    assert got.sizes()["n_train"] == 24 and got.steps[-1].endswith("random")


def test_wide_table_loses_its_copy(spark):
    r = np.random.default_rng(3)
    x = {f"feat_{i}": r.normal(size=100) for i in range(12)}
    x["feat_corr"] = x["feat_0"] * 0.999
    df = frame(spark, {**x, "y": (x["feat_0"] > 0).astype(int)})
    got = run_pipeline(df, "id", "y", "Classification", scaling="none", selection={"method": "correlation", "threshold": 0.9})
    assert "feat_corr" not in got.features and "feat_0" in got.features and len(got.features) == 12


def test_regression_with_outliers(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=120)
    o = np.append(r.normal(size=115), [1000.0, -1000, 500, -500, 800])
    df = frame(spark, {"x": x, "o": o, "y": 3.5 * x + r.normal(0, 0.1, 120)})
    got = run_pipeline(df, "id", "y", "Regression", scaling="robust")
    assert got.scaling == "robust" and all(np.isfinite(v["o"]) for v in got.data.collect())
    _, metrics, _, _ = L.train(got.data, got.features, "y", "linear_regression", "regression", key="id")
    assert metrics["r2"] > 0.9


def test_sequential_without_target_and_empty_selection(spark):
    df = frame(spark, {"v": np.arange(50.0)})
    got = run_pipeline(df, "id")
    assert {r["id"] for r in got.test.collect()} == set(range(40, 50)) and got.target is None


def test_stacking_learns_from_out_of_fold_probabilities(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 2))
    df = frame(spark, {"a": x[:, 0], "b": x[:, 1], "y": (x.sum(1) > 0).astype(int)})
    model, metrics, _, classes = L.train(df, ["a", "b"], "y", "stacking", "classification", key="id")
    assert metrics["accuracy"] > 0.8 and model.n_classes == 2


def test_one_class_svm_flags_its_share(spark):
    from tessera.operators.anomaly import one_class_svm
    r = np.random.default_rng(6)
    df = frame(spark, {"a": r.normal(size=400), "b": r.normal(size=400)})
    n = one_class_svm(df, ["a", "b"], "id", nu=0.1).where("is_anomaly").count()
    assert 35 <= n <= 45


def test_nothing_to_divide_by(spark):
    from tessera.operators import evaluate as EV
    from tessera.operators.anomaly import outliers
    df = spark.createDataFrame([(1, None, 0, 0.2), (2, None, 0, 0.8)], "id int, v double, y int, s double")
    for method in ("iqr", "zscore"):
        assert outliers(df, method, cols=["v"]).first()["outlier_count"] == 0
    assert {r["tpr"] for r in EV.roc_curve(df, "y", "s").collect()} == {None}
    assert EV.precision_recall_curve(df, "y", "s").count() == 3
    m = EV.regression_metrics(df.withColumn("p", df.s), "v", "p").first()
    assert m["n"] == 0 and m["rmse"] is None
    nul = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (5.0, 4.0)], "v double, p double")
    assert EV.regression_metrics(nul, "v", "p").first()["medae"] == 1.0
