import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import forest
from tessera.operators import learners as L


def table(spark, n=6000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 F.pmod(F.xxhash64("id"), F.lit(100)).alias("noise")) \
        .withColumn("y", ((F.col("a") > 3) & (F.col("noise") < 95)).cast("int")).withColumn("v", 10 * F.col("a") + F.col("b") + F.col("noise") / 100)


def plain(monkeypatch):
    monkeypatch.setattr(forest, "pays", lambda made: False)


def test_a_forest_grows_on_cells_and_agrees_with_that_on_rows(spark, monkeypatch, tmp_path):
    df, seen = table(spark), []
    monkeypatch.setattr(forest, "LEAST_ROWS", 0)
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d, *p: seen.append(d.count()) or fit(self, d, *p))
    for label, problem in (("y", "classification"), ("v", "regression")):
        model, metrics, _, _ = L.train(df, ["a", "b"], label, "random_forest", problem, {"n_estimators": 12}, key="k")
        again, same, _, _ = L.train(df, ["a", "b"], label, "random_forest", problem, {"n_estimators": 12}, key="k")
        last = model.stages[-1]
        assert last.getNumTrees == 12 and len(last.trees) == 12 and abs(sum(last.featureImportances) - 1) < 1e-9
        assert metrics[L.primary(problem)] == same[L.primary(problem)]
        if problem == "classification":
            assert len(seen) == 24 and max(seen) <= 70      # 35 cells, two classes
            model.write().overwrite().save(f"{tmp_path}/m")
            loaded = type(model).load(f"{tmp_path}/m")
            p = [[r["prediction"] for r in m.transform(df).orderBy("k").collect()] for m in (model, loaded)]
            assert p[0] == p[1]
        with monkeypatch.context() as m:
            plain(m)
            _, rows, _, _ = L.train(df, ["a", "b"], label, "random_forest", problem, {"n_estimators": 12}, key="k")
        # few trees of one feature a split: as far apart as those of two seeds
        assert abs(metrics[L.primary(problem)] - rows[L.primary(problem)]) < 0.06


def test_draws_of_cells_are_those_of_their_rows():
    rng = np.random.default_rng(1)
    times = forest._times(rng, np.array([50.0, 3.0]), 20_000, 1.0, True)
    assert np.allclose(times.mean(1), [50, 3], rtol=0.02) and np.allclose(times.var(1), [50, 3], rtol=0.05)
    assert (forest._times(rng, np.array([4.0]), 3, 1.0, False) == 4).all()
    assert forest._times(rng, np.array([4.0]), 100, 0.5, False).max() <= 4


def test_sums_of_a_stream():
    rng = np.random.default_rng(2)
    parts = [(np.unique(rng.integers(0, 50, 20)), None) for _ in range(40)]
    parts = [(c, np.stack([np.ones(len(c)), c.astype(float)], 1)) for c, _ in parts]
    want = np.zeros((50, 2))
    for c, s in parts:
        want[c] += s
    for most in (np.inf, 200):
        got = np.zeros((50, 2))
        for c, s in forest._summed(iter(parts), 2, most):
            got[c] += s
        assert np.array_equal(got, want)


def test_equal_rows_are_one_to_the_logistic_loss(spark, monkeypatch):
    df = table(spark)
    weighted, m1, _, _ = L.train(df, ["a", "b"], "y", "logistic_regression", key="k")
    monkeypatch.setattr(forest, "ROWS_A_CELL", 10 ** 9)
    rows, m2, _, _ = L.train(df, ["a", "b"], "y", "logistic_regression", key="k")
    a, b = weighted.stages[-1], rows.stages[-1]
    assert a.hasParam("weightCol") and a.isSet("weightCol") and not b.isSet("weightCol")
    assert np.allclose(a.coefficients, b.coefficients, rtol=1e-3) and abs(a.intercept - b.intercept) < 1e-2 * (1 + abs(b.intercept))
    assert m1["accuracy"] == m2["accuracy"]
