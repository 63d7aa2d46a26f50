"""Support vector machines: optimality by the duality gap, kernels, probabilities."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learners as L
from tessera.operators import svm as S
from tessera.operators import tune as TU


def _frame(spark, x, y):
    return spark.createDataFrame([(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, y double, " + ", ".join(f"f{j} double" for j in range(x.shape[1]))).repartition(4)


def _solved(spark, x, y, c, epsilon=None, scale=1.0):
    rows = _frame(spark, x, y).select(F.array(*[f"f{j}" for j in range(x.shape[1])]).alias("x"), "y", F.lit(0).alias("fold")).cache()
    side = 1 if epsilon is None else None
    return S.solve(rows, x.shape[1], [S.Machine(len(x), c, side, epsilon=epsilon, scale=scale)])[0]


def _value(w, x, y, c, epsilon):
    f = x @ w[:-1] + w[-1]
    u = 1 - y * f if epsilon is None else np.abs(y - f) - epsilon
    return w[:-1] @ w[:-1] / 2 + c * np.maximum(0, u).sum()


def _optimum(x, y, c, epsilon, scale):
    """The objective's least value, proved by a dual point: Newton steps to the end, in numpy."""
    m = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.ones(x.shape[1]), 1e-9)
    w = np.zeros(m.shape[1])
    for h in scale * 10.0 ** np.arange(0, -7.5, -0.5):
        at = lambda w: (c * S.losses(m @ w, y, epsilon, h)[0].sum() + ridge @ (w * w) / 2)  # noqa: B023, E731
        for _ in range(200):
            _, g, b = S.losses(m @ w, y, epsilon, h)
            grad = c * g @ m + ridge * w
            step = np.linalg.solve(c * (m * b[:, None]).T @ m + np.diag(ridge) + 1e-9 * np.eye(len(w)), -grad)
            t = 1.0
            while at(w + t * step) > at(w) and t > 1e-9:
                t /= 2
            w = w + t * step
            if np.abs(grad).max() < 1e-9 * c * len(x):
                break
    _, g, _ = S.losses(m @ w, y, epsilon, h)
    beta = -c * g
    v = beta @ x
    u = beta @ y - epsilon * np.abs(beta).sum() if epsilon is not None else np.abs(beta).sum()
    low = u - v @ v / 2 - w[-1] * beta.sum()
    best = _value(w, x, y, c, epsilon)
    assert best - low < 2e-3 * best, (best, low)
    return best


@pytest.mark.parametrize("c", [0.05, 10.0])
def test_losses_within_one_percent_of_the_optimum(spark, c):
    r = np.random.default_rng(1)
    x = r.normal(size=(150, 4)) * [1, 2, 0.5, 1]
    y = x @ [1.0, -0.5, 2.0, 0.0] + 3 + 0.3 * r.standard_t(2, 150)
    scale = float(np.std(y))
    assert _value(_solved(spark, x, y, c, 0.2, scale), x, y, c, 0.2) <= 1.01 * _optimum(x, y, c, 0.2, scale)
    side = np.where(x @ [1, -1, 0.5, 0] + 0.4 * r.normal(size=150) > 0.2, 1.0, -1.0)
    assert _value(_solved(spark, x, side, c), x, side, c, None) <= 1.01 * _optimum(x, side, c, None, 1.0)


def test_monomials_are_the_kernel(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(6, 3))
    df = _frame(spark, x, np.zeros(6)).orderBy("id")
    names = ["f0", "f1", "f2"]
    for degree, gamma in itertools.product((1, 2, 3, 4), (0.5, 2.0)):
        z = np.array([r["v"] for r in df.select(F.array(*[F.expr(t) for t in S.kernel_map(names, "poly", gamma, degree)]).alias("v"))
                      .collect()])
        order = [i["id"] for i in df.select("id").collect()]
        assert np.allclose(z @ z.T, (gamma * x[order] @ x[order].T) ** degree)
    near = np.array([r["v"] for r in df.select(F.array(*[F.expr(t) for t in S.kernel_map(names, "rbf", 0.3, size=300)]).alias("v")).collect()])
    d2 = ((x[order][:, None] - x[order][None]) ** 2).sum(2)
    assert np.abs(near @ near.T - np.exp(-0.3 * d2)).max() < 0.25


def test_gamma_words(spark):
    r = np.random.default_rng(4)
    x = r.normal(1, 3, (80, 2))
    df = _frame(spark, x, np.zeros(80))
    cols = [F.col("f0"), F.col("f1")]
    assert S.resolve_gamma(df, cols, "scale") == pytest.approx(1 / (2 * x.var()))
    assert S.resolve_gamma(df, cols, "auto") == 0.5 and S.resolve_gamma(df, cols, 0.1) == 0.1
    with pytest.raises(ValueError):
        S.resolve_gamma(df, cols, "wide")


def _rings(spark, n=300):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 2)) * 3
    y = (np.hypot(*x.T) > 3).astype(int)
    return _frame(spark, x, y), x, y


def test_degrees_and_gammas_give_different_models_that_learn(spark, tmp_path):
    df, x, y = _rings(spark)
    d, classes = L.prepare_label(df.withColumn("y", F.col("y").cast("int")), "y", "classification")
    seen = set()
    for params in ({"kernel": "poly", "degree": 2}, {"kernel": "poly", "degree": 3}, {"kernel": "poly", "degree": 4},
                   {"kernel": "poly", "degree": 2, "gamma": "auto"}, {"kernel": "rbf"}):
        m = L._fit_one(d, ["f0", "f1"], "svm", "classification", params, 2, 42, only_score=True)
        acc = L.score(m.transform(d), "classification")["accuracy"]
        seen.add(str(m.stages[-2].getStatement()))
        assert acc > (0.9 if params["kernel"] == "rbf" or params.get("degree") in (2, 4) else 0.4), params
    assert len(seen) == 5
    m = L._fit_one(d, ["f0", "f1"], "svm", "classification", None, 2, 42)
    m.write().overwrite().save(f"{tmp_path}/svm")
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(f"{tmp_path}/svm")
    a, b = ({r["id"]: (r["prediction"], r["class_probabilities"]) for r in L.predict(k, df, classes).collect()} for k in (m, again))
    assert a == b
    # out-of-fold sigmoids: of rows given p, about p are positive
    p = np.array([a[i][1][1] for i in range(len(y))])
    for lo, hi in ((0, 0.25), (0.25, 0.75), (0.75, 1.01)):
        here = (p >= lo) & (p < hi)
        if here.sum() >= 15:
            assert abs(p[here].mean() - y[here].mean()) < 0.2
    assert abs(p.mean() - y.mean()) < 0.05


def test_three_classes_have_probabilities(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(c, 0.8, (50, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = _frame(spark, x, np.repeat([0, 1, 2], 50)).withColumn("y", F.col("y").cast("int"))
    d, classes = L.prepare_label(df, "y", "classification")
    out = L.predict(L._fit_one(d, ["f0", "f1"], "svm", "classification", {"kernel": "linear"}, 3, 42), d, classes).collect()
    assert np.mean([int(r["predicted_label"]) == r["y"] for r in out]) > 0.95
    assert all(abs(sum(r["class_probabilities"]) - 1) < 1e-9 for r in out)
    assert np.mean([r["class_probabilities"][r["y"]] for r in out]) > 0.75


def test_no_duplicate_trials_and_a_fitted_best_model(spark):
    points = TU._grid_points(TU.GRIDS["svm"])
    assert len(points) == len({str(p) for p in points}) == 3 + 6
    df, x, y = _rings(spark, 120)
    df = df.withColumn("y", F.col("y").cast("int"))
    model, best, value, trials = TU.search_and_fit(df, ["f0", "f1"], "y", "svm", "classification", "id", method="grid", k=2,
                                                   space={"C": [1.0], "kernel": ["linear", "poly"], "gamma": ["scale"], "degree": [2]})
    assert best["kernel"] == "poly" and value > 0.9 and trials.count() == 2
    assert "probability" in model.transform(L.prepare_label(df, "y", "classification")[0]).columns


def test_regression_kernel_follows_a_curve(spark):
    r = np.random.default_rng(7)
    x = r.uniform(-3, 3, (200, 1))
    y = np.sin(x[:, 0]) + 0.05 * r.normal(size=200)
    d, _ = L.prepare_label(_frame(spark, x, y), "y", "regression")
    m = L._fit_one(d, ["f0"], "svm", "regression", {"C": 10.0}, 0, 42)
    assert L.score(m.transform(d), "regression")["r2"] > 0.95
