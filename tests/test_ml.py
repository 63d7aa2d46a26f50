"""Learners and neighbours: the reference's end-to-end scenario intents."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import learners as L
from tessera.operators import neighbors as NB


def test_plain_classification_accuracy(spark):
    rng = np.random.default_rng(0)
    f1, f2 = rng.normal(size=300), rng.normal(size=300)
    y = (2 * f1 + f2 > 0).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(f1, f2, y))]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, y int")
    model, metrics, cv, _ = L.train(df, ["f1", "f2"], "y", "random_forest", "classification",
                                    {"n_estimators": 20}, key="id", cv="stratified", folds=3)
    assert metrics["accuracy"] > 0.7
    assert cv.agg(F.avg("accuracy")).first()[0] > 0.7


def test_knn_pairs_exact(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "k long, x double, y double")
    got = NB.knn_pairs(df, df, "k", ["x", "y"], 3).collect()
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    want = {(i, int(j)) for i in range(200) for j in np.argsort(d2[i], kind="stable")[:3]}
    assert {(r["q"], r["p"]) for r in got} == want


def test_smote_grows_minority(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1 if i < 6 else 0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = NB.smote(df, "y", "id", ["a", "b"])
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 144, 1: 144}


def _dbscan_brute(pts, eps, min_samples):
    n = len(pts)
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    nb = [set(np.where(d2[i] <= eps * eps)[0]) for i in range(n)]
    core = {i for i in range(n) if len(nb[i]) >= min_samples}
    comp = {}
    for c in sorted(core):
        if c in comp:
            continue
        stack, comp[c] = [c], c
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if v in core and v not in comp:
                    comp[v] = c
                    stack.append(v)
    ids = {r: i for i, r in enumerate(sorted(set(comp.values())))}
    lab = {}
    for i in range(n):
        if i in core:
            lab[i] = ids[comp[i]]
        else:
            cs = [ids[comp[j]] for j in nb[i] if j in core]
            lab[i] = min(cs) if cs else -1
    return lab


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = np.concatenate([rng.normal(0, 0.3, size=(60, 2)), rng.normal(3, 0.3, size=(60, 2)),
                          rng.uniform(-2, 5, size=(20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "k long, x double, y double")
    got = {r["k"]: r["cluster"] for r in NB.dbscan(df, "k", ["x", "y"], 0.4, 5).collect()}
    assert got == _dbscan_brute(pts, 0.4, 5)


def test_isolation_forest_flags_contamination(spark):
    from tessera.operators.anomaly import isolation_forest
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(size=(400, 2)), rng.normal(8, 0.5, size=(10, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "k long, x double, y double")
    out = isolation_forest(df, ["x", "y"], "k", n_trees=30, contamination=0.05)
    flagged = {r["k"] for r in out.where("is_anomaly").collect()}
    assert abs(len(flagged) - 0.05 * 410) <= 2
    assert len(flagged & set(range(400, 410))) >= 8


def test_kernel_shap_matches_linear_closed_form(spark):
    from tessera.operators import explain as EXP
    rng = np.random.default_rng(11)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([2.0, -1.0, 0.5]) + 0.1 * rng.normal(size=200)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    model, *_ = L.train(df, ["a", "b", "c"], "y", "linear_regression", "regression", key="id")
    coef = model.stages[-1].coefficients.toArray()
    means = X.mean(axis=0)
    got = {(r["id"], r["feature"]): r["shap"]
           for r in EXP.kernel_shap(model, df, ["a", "b", "c"], "id").collect()}
    for i in range(0, 200, 37):
        for j, f in enumerate("abc"):
            assert abs(got[(i, f)] - coef[j] * (X[i, j] - means[j])) < 1e-6


def test_queries_run_the_operators_defaults(spark, monkeypatch):
    """No query asks for fewer trees, rounds, folds, trials or perturbations."""
    import __spark_entry__ as E
    from tessera.queries import ml_q as Q
    qs, calls = E.queries(), []

    class Asked(Exception):
        pass

    def told(*args, **kw):
        calls.append((args, kw))
        raise Asked

    for module, name in ((Q.L, "train"), (Q.L, "compare_models"), (Q.L, "cross_val_score"), (Q.L, "learning_curve"), (Q.TU, "search")):
        monkeypatch.setattr(module, name, told)
    for source in ("lineitem_cls", "labels_cls", "customer_cls"):
        monkeypatch.setattr(Q, source, lambda spark, sf: None)
    monkeypatch.setattr(Q.L, "prepare_label", lambda *a: (None, [0, 1]))
    for name in ("train_random_forest", "train_gradient_boosting", "train_random_forest_regression", "train_xgboost_preset",
                 "train_lightgbm_preset", "train_catboost_preset", "train_svm_poly", "feature_importance", "compare_models",
                 "cross_val_score", "learning_curve", "grid_search", "random_search", "bayesian_search"):
        try:
            qs[name](spark, "")
        except Asked:
            pass
        args, kw = calls.pop()
        assert not {"k", "budget", "space", "model_types"} & set(kw), name
        assert not any(isinstance(a, int) or isinstance(a, dict) and "n_estimators" in a for a in [*args, *kw.values()]) \
            or name == "cross_val_score" and kw == {"n_classes": 2} and 3 not in args, name
    # LIME's own perturbations
    monkeypatch.setattr(Q.L, "train", lambda *a, **k: (None,))
    monkeypatch.setattr(Q.EX, "lime_explain", told)
    try:
        qs["lime_explain"](spark, "")
    except Asked:
        pass
    assert "n_samples" not in calls.pop()[1]


def test_dbscan_dense_cells(spark):
    """Cells of many points that touch, almost touch, or hold copies of one point."""
    rng = np.random.default_rng(8)
    eps = 1.0
    pts = np.concatenate([rng.uniform(0, 0.7, (260, 2)), rng.uniform(0, 0.7, (260, 2)) + [1.5, 0],
                          rng.uniform(0, 0.5, (200, 2)) + [5, 5], rng.uniform(0, 0.5, (200, 2)) + [6.2, 6.2],
                          np.tile([[-5.0, -5.0]], (90, 1)), np.tile([[-4.0, -5.0]], (90, 1)), np.tile([[-5.0, -3.9]], (90, 1))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k long, x double, y double")
    got = {r["k"]: r["cluster"] for r in NB.dbscan(df, "k", ["x", "y"], eps, 5).collect()}
    assert got == _dbscan_brute(pts, eps, 5)


def test_dbscan_two_dense_cells_take_no_square_of_time(spark):
    import time
    rng = np.random.default_rng(9)

    def run(n):
        pts = np.concatenate([rng.uniform(0, 0.7, (n, 2)), rng.uniform(0, 0.7, (n, 2)) + [1.0, 0]])
        df = spark.createDataFrame(list(zip(range(2 * n), *pts.T.tolist())), "k long, x double, y double").cache()
        df.count()
        t = time.time()
        assert NB.dbscan(df, "k", ["x", "y"], 1.0, 5).select("cluster").distinct().count() == 1
        return time.time() - t

    run(500)
    assert run(24_000) < 3 * run(8_000) + 2
