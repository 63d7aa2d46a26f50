"""Hyper-parameter search: grid, random and a tree-structured Parzen search.

Every trial is a cross-validated fit (folds assigned once, data cached);
trials within a batch run concurrently, and decision trees of a batch are grown
together (:mod:`grove`).  Parameter names follow the common
single-table ML vocabulary and are translated to ``pyspark.ml`` by
:mod:`learners`.
"""

from __future__ import annotations

import itertools
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grove
from . import learners as L
from .split import FOLD, assign_folds

# The usual grids and random-search choices, for the parameters that
# Spark's estimators have (a tree depth of None is unlimited, as far as Spark goes).
GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20],
                      "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2],
                          "max_depth": [3, 5, 7], "subsample": [0.8, 0.9, 1.0]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "max_iter": [100, 500, 1000]},
    "linear_regression": {"fit_intercept": [True, False]},
    "decision_tree": {"max_depth": [None, 10, 20], "min_samples_leaf": [1, 2, 4]},
    "knn": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
}
DISTRIBUTIONS = {
    "random_forest": {"n_estimators": [50, 100, 150, 200, 250, 300], "max_depth": [None, 5, 10, 15, 20, 25],
                      "min_samples_leaf": [1, 2, 3, 4, 5], "max_features": ["sqrt", "log2", None]},
    "gradient_boosting": {"n_estimators": [50, 100, 150, 200, 250, 300],
                          "learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2, 0.25],
                          "max_depth": [3, 5, 7, 9, 11], "subsample": [0.6, 0.7, 0.8, 0.9, 1.0]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "max_iter": [100, 200, 500, 1000],
                            "penalty": ["l2", "l1"]},
    "decision_tree": {"max_depth": [None, 5, 10, 15, 20, 25], "min_samples_leaf": [1, 2, 3, 4, 5],
                      "criterion": ["gini", "entropy"]},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"]},
    "svm": {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"],
            "degree": [2, 3, 4]},
}
RANGES = {  # (low, high, kind) for the Parzen search; lists are categorical
    "random_forest": {"n_estimators": (20, 300, "int"), "max_depth": (3, 20, "int"),
                      "min_samples_leaf": (1, 8, "int")},
    "gradient_boosting": {"n_estimators": (20, 300, "int"), "learning_rate": (0.01, 0.3, "float"),
                          "max_depth": (2, 8, "int")},
    "logistic_regression": {"C": (0.01, 100.0, "float")},
    "decision_tree": {"max_depth": (2, 20, "int"), "min_samples_leaf": (1, 8, "int")},
    "svm": {"C": (0.01, 100.0, "float"), "kernel": ["linear", "rbf"]},
    "knn": {"n_neighbors": (1, 15, "int"), "weights": ["uniform", "distance"]},
}


def _in_use(p: dict) -> dict:
    """A point without the parameters that its kernel has not."""
    unused = {"linear": ("gamma", "degree"), "rbf": ("degree",)}.get(p.get("kernel"), ())
    return {k: v for k, v in p.items() if k not in unused}


def _grid_points(space: dict) -> list[dict]:
    keys = sorted(space)
    points = [_in_use(dict(zip(keys, vals))) for vals in itertools.product(*[space[k] for k in keys])]
    return list({str(p): p for p in points}.values())


def _clean(p: dict) -> dict:
    out = dict(p)
    if out.get("fit_intercept") is not None:
        out["fitIntercept"] = out.pop("fit_intercept")
    return out


class _Evaluator:
    def __init__(self, df, features, label, model_type, problem, key, k, seed):
        d, classes = L.prepare_label(df, label, problem)
        method = "stratified" if classes else "kfold"
        if classes:
            smallest = min(r[1] for r in d.groupBy(L.LABEL).count().collect())
            k = max(2, min(k, smallest))
        self.folds, self.k = assign_folds(d, key, method, k, label=L.LABEL if classes else None,
                                          seed=seed)
        self.folds = self.folds.withColumn("_row_key", F.col(key)).cache()
        self.features, self.model_type, self.problem = list(features), model_type, problem
        self.n_classes = len(classes or [])
        self.seed = seed
        # trees see cells of binned features: counted once for each fold, not once a trial
        self.made = None
        if model_type in L.TREES:
            rows = grove.dense(self.folds)
            with ThreadPoolExecutor(max_workers=4) as ex:
                self.made = list(ex.map(lambda f: L.feature_cells(rows.where(F.col(FOLD) != f), self.features, problem), range(self.k)))
        # decision trees of a batch are grown at once; what they scored, by fold and setting
        self.grove = L.grove_for(self.folds, self.features, model_type, problem, self.n_classes,
                                 [grove.Subset(F.col(FOLD) != f, F.col(FOLD) == f) for f in range(self.k)], self.made)
        self.known: dict = {}

    def prepare(self, points: list[dict]):
        """Scores the trees of all ``points`` in one job, where these can be grown together."""
        if self.grove is not None:
            new = {s for s in (grove.setting(_clean(p)) for p in points) if s is not None and (0, s) not in self.known}
            if new:
                self.known.update(self.grove.scores(sorted(new)))

    def __call__(self, params: dict) -> tuple[float, float]:
        scores = []
        grown = grove.setting(_clean(params)) if self.grove is not None else None
        for f in range(self.k):
            if (f, grown) in self.known:
                scores.append(self.known[(f, grown)][1])
                continue
            tr = self.folds.where(F.col(FOLD) != f)
            te = self.folds.where(F.col(FOLD) == f)
            m = L._fit_one(tr, self.features, self.model_type, self.problem, _clean(params),
                           self.n_classes, self.seed, only_score=True, made=self.made and self.made[f])
            scores.append(L.score(m.transform(te), self.problem)[L.primary(self.problem)])
        mean = sum(scores) / len(scores)
        std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
        return mean, std

    def close(self):
        self.folds.unpersist()
        for made in self.made or ():
            made.close()
        if self.grove is not None:
            self.grove.close()


def _run_trials(ev, points, parallel=4):
    def one(p):
        try:
            m, s = ev(p)
            return p, m, s, None
        except Exception as exc:  # noqa: BLE001 - a failing trial scores nothing
            return p, None, None, str(exc)[:300]
    ev.prepare(points)
    with ThreadPoolExecutor(max_workers=parallel) as ex:
        return list(ex.map(one, points))


def _trials_df(spark, results, metric):
    rows = [(i + 1, str(sorted(p.items())), m, s, e) for i, (p, m, s, e) in enumerate(results)]
    return spark.createDataFrame(rows, f"trial int, params string, mean_{metric} double, "
                                       f"std_{metric} double, error string")


def search(df: DataFrame, features, label, model_type="random_forest", problem="classification",
           key=None, method="grid", budget=50, k=5, seed=42, space=None, timeout=None,
           parallel=4):
    """Returns ``(best_params, best_score, trials_df)``."""
    mt = L.canonical(model_type)
    ev = _Evaluator(df, features, label, mt, problem, key, k, seed)
    metric = L.primary(problem)
    try:
        if method == "grid":
            results = _run_trials(ev, _grid_points(space or GRIDS[mt]), parallel)
        elif method == "random":
            # points without repetition from the choices, whose product is never listed
            rng, choices, seen, pts = random.Random(seed), space or DISTRIBUTIONS.get(mt, GRIDS[mt]), set(), []
            most = len(_grid_points(choices)) if "kernel" in choices else math.prod(len(v) for v in choices.values())
            while len(pts) < min(budget, most):
                p = _in_use({k: rng.choice(v) for k, v in sorted(choices.items())})
                if str(p) not in seen:
                    seen.add(str(p))
                    pts.append(p)
            results = _run_trials(ev, pts, parallel)
        elif method == "bayesian":
            results = _parzen(ev, space or RANGES[mt], budget, seed, timeout, parallel)
        else:
            raise ValueError(f"unknown search method {method}")
    finally:
        ev.close()
    ok = [r for r in results if r[1] is not None]
    best = max(ok, key=lambda r: r[1]) if ok else (None, None, None, None)
    return best[0], best[1], _trials_df(df.sparkSession, results, metric)


def search_and_fit(df: DataFrame, features, label, model_type="random_forest", problem="classification", key=None, **options):
    """``search``, then the best parameters fitted on all rows: ``(model, best_params,
    best_score, trials_df)``."""
    best, value, trials = search(df, features, label, model_type, problem, key, **options)
    if best is None:
        raise ValueError("no trial succeeded")
    d, classes = L.prepare_label(df, label, problem)
    model = L._fit_one(d.withColumn("_row_key", F.col(key)), list(features), model_type, problem, _clean(best),
                       len(classes or []), options.get("seed", 42))
    return model, best, value, trials


def _sample(space, rng, good=None):
    p = {}
    for name, spec in space.items():
        if isinstance(spec, list):
            if good:
                vals = [g[name] for g in good] + spec
                p[name] = rng.choice(vals)
            else:
                p[name] = rng.choice(spec)
            continue
        lo, hi, kind = spec
        if good:
            centre = rng.choice([g[name] for g in good])
            width = (hi - lo) / 6.0
            v = min(hi, max(lo, rng.gauss(centre, width)))
        else:
            v = rng.uniform(lo, hi)
        p[name] = int(round(v)) if kind == "int" else float(v)
    return p


def _parzen(ev, space, budget, seed, timeout, parallel):
    """Tree-structured Parzen search (Bergstra et al. 2011), simplified: after
    a random start, candidates are drawn around the best quarter of trials and
    the one with the highest good/bad density ratio is evaluated; trials run in
    batches of ``parallel`` until the budget (or a time limit, if one is given)."""
    rng = random.Random(seed)
    results = []
    start = time.time()
    n_start = min(max(parallel, 5), budget)
    results += _run_trials(ev, [_sample(space, rng) for _ in range(n_start)], parallel)
    while len(results) < budget and (timeout is None or time.time() - start < timeout):
        ok = sorted([r for r in results if r[1] is not None], key=lambda r: -r[1])
        good = [r[0] for r in ok[:max(1, len(ok) // 4)]]
        bad = [r[0] for r in ok[max(1, len(ok) // 4):]] or good

        def density(p, pts):
            tot = 0.0
            for q in pts:
                dd = 0.0
                for name, spec in space.items():
                    if isinstance(spec, list):
                        dd += 0.0 if p[name] == q[name] else 1.0
                    else:
                        lo, hi, _ = spec
                        dd += ((p[name] - q[name]) / ((hi - lo) or 1.0)) ** 2
                tot += math.exp(-dd / 0.05)
            return tot / len(pts) + 1e-12

        batch = []
        for _ in range(min(parallel, budget - len(results))):
            cands = [_sample(space, rng, good) for _ in range(24)]
            batch.append(max(cands, key=lambda c: density(c, good) / density(c, bad)))
        results += _run_trials(ev, batch, parallel)
    return results
