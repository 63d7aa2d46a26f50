"""Machines hold the inputs of distinct rows, not their map; copies count as often as they occur."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learners as L
from tessera.operators import svm as S


@pytest.mark.parametrize("kernel,degree,dims", [("linear", 3, 3), ("rbf", 3, 3), ("poly", 2, 3), ("poly", 4, 9)])
def test_points_are_the_map(spark, kernel, degree, dims):
    x = np.random.default_rng(0).normal(size=(20, dims))
    names = [f"f{j}" for j in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))
    terms = S.kernel_map(names, kernel, 0.3, degree, 5, 40)
    want = np.array([r[0] for r in df.orderBy("id").select(F.array(*[F.expr(t) for t in terms])).collect()])
    assert np.allclose(want, S.kernel_points(x, kernel, 0.3, degree, 5, 40), atol=1e-9)


def test_copies_weigh_and_only_inputs_are_held(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.integers(0, 6, (300, 2)).astype(float)
    y = ((x[:, 0] - 2.5) ** 2 + (x[:, 1] - 2.5) ** 2 + r.normal(scale=0.5, size=300) < 4).astype(int)
    df = spark.createDataFrame([(i, *map(float, p), int(t)) for i, (p, t) in enumerate(zip(x, y))], "id long, f0 double, f1 double, y int")
    d, _ = L.prepare_label(df, "y", "classification")
    held, solve = [], S.solve
    monkeypatch.setattr(S, "solve", lambda rows, *a: held.append((rows.select(F.max(F.size("x"))).first()[0], rows.count())) or solve(rows, *a))
    model = L._fit_one(d, ["f0", "f1"], "svm", "classification", {"kernel": "rbf"}, 2, 42)
    assert held[0][0] == 2 and held[0][1] <= 72
    right = model.transform(d).select(F.avg((F.col("prediction") == F.col(L.LABEL)).cast("double"))).first()[0]
    assert right > 0.85

    # each row once, and each row counted as often as it occurs: the same machine
    rows = d.select(F.array("f0", "f1").alias("x"), F.col(L.LABEL).alias("y"), F.lit(0).alias("fold"))
    once = solve(rows, 2, [S.Machine(300, 1.0, 1)])[0]
    often = solve(rows.groupBy("x", "y", "fold").agg(F.count(F.lit(1)).alias("n")), 2, [S.Machine(300, 1.0, 1)])[0]
    assert np.allclose(once, often, atol=1e-9)
