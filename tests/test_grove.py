import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import grove
from tessera.operators import learners as L
from tessera.operators import tune as TU
from tessera.operators.split import FOLD, assign_folds


def rows(n, seed=1):
    """A feature of many values, one of few, with nulls, NaN and copies, and noisy classes."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.choice([None, float("nan"), 0.0, -1.5]) if r.random() < 0.05 else round(r.gauss(0, 100), 1)
        b = r.choice([None, 1, 2, 3, 5, 8, 13])
        right = "x" if (a or 0) > 10 and (b or 0) < 5 else "y" if (b or 0) > 4 else "z"
        out.append((i, a, b, right if r.random() < 0.7 else r.choice("xyz")))
    return out


def test_trees_as_spark_grows_them(spark):
    d, classes = L.prepare_label(spark.createDataFrame(rows(500), "id long, a double, b int, y string").repartition(5), "y", "classification")
    d, k = assign_folds(d, "id", "stratified", 3, label=L.LABEL)
    d = d.cache()
    subsets = [grove.Subset(F.col(FOLD) != f, F.col(FOLD) == f) for f in range(k)]
    made = L.grove_for(d, ["a", "b"], "decision_tree", "classification", len(classes), subsets)
    points = [{}, {"max_depth": None}, {"max_depth": 0}, {"max_depth": 3, "min_samples_leaf": 4}, {"max_depth": 9, "criterion": "entropy"},
              {"max_depth": None, "min_samples_leaf": 2, "criterion": "entropy"}, {"min_samples_leaf": 150}, {"min_samples_leaf": 400}]
    got = made.scores([grove.setting(p) for p in points])
    made.close()
    for p in points:
        for f in range(k):
            tr, te = d.where(F.col(FOLD) != f), d.where(F.col(FOLD) == f)
            m = L._fit_one(tr, ["a", "b"], "decision_tree", "classification", p, len(classes), 42)
            want = tuple(L.score(m.transform(x), "classification")["accuracy"] for x in (tr, te))
            assert got[(f, grove.setting(p))] == want, (p, f)
    d.unpersist()


def test_settings():
    assert grove.setting(None) == ("gini", 1, 5) and grove.setting({"max_depth": None}) == ("gini", 1, 30)
    for p in ({"max_depth": 31}, {"min_samples_leaf": 0}, {"criterion": "gini", "max_bins": 9}, {"max_depth": 2.5}):
        assert grove.setting(p) is None


@pytest.mark.parametrize("method", ["grid", "random", "bayesian"])
def test_a_search_fits_no_tree_one_by_one(spark, monkeypatch, method):
    """50 trials of five folds were 250 fits of many jobs each, one after the other."""
    df = spark.createDataFrame(rows(400, 2), "id long, a double, b int, y string")
    fits, plain = [], L._fit_one
    monkeypatch.setattr(L, "_fit_one", lambda *a, **k: fits.append(a[4]) or plain(*a, **k))
    best, value, trials = TU.search(df, ["a", "b"], "y", "decision_tree", "classification", "id", method, budget=12)
    got = trials.collect()
    assert len(got) == (9 if method == "grid" else 12) and all(r.error is None for r in got) and not fits
    assert math.isclose(value, max(r.mean_accuracy for r in got))
    # what it does not know goes the long way, an impossible depth fails alone
    _, _, trials = TU.search(df, ["a", "b"], "y", "decision_tree", "classification", "id", space={"max_depth": [2, 99]}, k=2)
    assert [r.error is None for r in trials.orderBy("trial").collect()] == [True, False] and len(fits) == 1


def test_learning_curve_grows_its_trees_together(spark, monkeypatch):
    df = spark.createDataFrame(rows(400, 3), "id long, a double, b int, y string")
    want = None
    for bound in (0, grove.CELLS):      # tree by tree, then together
        monkeypatch.setattr(grove, "CELLS", bound)
        fits, plain = [], L._fit_one
        monkeypatch.setattr(L, "_fit_one", lambda *a, **k: fits.append(a[4]) or plain(*a, **k))
        got = [tuple(r) for r in L.learning_curve(df, ["a", "b"], "y", "decision_tree", key="id", k=2, fractions=(0.2, 0.6, 1.0)).collect()]
        assert bool(fits) == (bound == 0) and got == (want or got)
        want = got
        monkeypatch.setattr(L, "_fit_one", plain)
