"""Metrics against hand-computed values."""

from tessera.operators import evaluate as EV


def test_confusion_metrics(spark):
    rows = [(1, 1)] * 40 + [(1, 0)] * 10 + [(0, 1)] * 5 + [(0, 0)] * 45
    df = spark.createDataFrame(rows, "y int, p int")
    m = EV.class_metrics(df, "y", "p")
    assert abs(m["accuracy"] - 0.85) < 1e-12
    assert abs(m["balanced_accuracy"] - (0.8 + 0.9) / 2) < 1e-12


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert abs(EV.roc_auc(df, "y", "s") - 0.875) < 1e-12


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "y double, p double")
    r = EV.regression_metrics(df, "y", "p").first()
    assert abs(r["mae"] - 0.5) < 1e-12 and abs(r["medae"] - 0.5) < 1e-12
    assert abs(r["r2"] - (1 - 2 / 5)) < 1e-12


def test_diagnosis():
    assert EV.diagnose(0.99, 0.8) == "overfitting"
    assert EV.diagnose(0.6, 0.5) == "underfitting"
    assert EV.diagnose(0.85, 0.8) == "good_fit"


def test_many_classes_and_nulls(spark):
    """20,000 classes, none of them read by the driver; a null is a class."""
    df = spark.range(60_000).selectExpr("id % 20000 as y", "if(id % 3 = 0, id % 20000, (id + 1) % 20000) as p")
    m = EV.class_metrics(df, "y", "p")
    assert m["n"] == 60_000 and m["accuracy"] == 1 / 3 and abs(m["balanced_accuracy"] - 1 / 3) < 1e-12
    rep = EV.classification_report(df, "y", "p")
    assert rep.count() == 20_002
    small = spark.createDataFrame([(1, 1), (None, 1), (None, None), (2, None)], "y int, p int")
    m = EV.class_metrics(small, "y", "p")
    assert m["accuracy"] == 0.5 and m["n"] == 4
    got = {(r["label"], r["prediction"]): r["count"] for r in EV.confusion_matrix(small, "y", "p").collect()}
    assert got == {(a, b): {("1", "1"): 1, (None, "1"): 1, (None, None): 1, ("2", None): 1}.get((a, b), 0)
                   for a in ("1", "2", None) for b in ("1", "2", None)}
    none = small.where("false")
    assert EV.class_metrics(none, "y", "p")["accuracy"] == 0.0 and EV.confusion_matrix(none, "y", "p").count() == 0
