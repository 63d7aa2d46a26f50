"""Supervised learners on ``pyspark.ml``, cross-validation and model comparison.

Every model is a ``PipelineModel``: feature coercion (non-numeric → 0) and
``VectorAssembler`` are stages of the saved pipeline, so ``predict`` applies
exactly the preprocessing the model was trained with — on batch or streaming
DataFrames.  Independent fits (folds, compared models) run concurrently from
a thread pool: Spark schedules their jobs side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import evaluate as EV
from . import forest, grove
from .binning import PART, WEIGHT, Cells, cells
from .split import FOLD, assign_folds

LABEL = "_label"
MAX_CLASSES = 10_000   # class lists are collected; larger label sets are refused
FEATURES = "_features"
PRED = "prediction"

# Accepted spellings of every model family (the reference's factory knew only
# some of them; both are accepted here).
ALIASES = {
    "random_forest": "random_forest", "random_forst": "random_forest", "rf": "random_forest",
    "randomforest": "random_forest",
    "gradient_boosting": "gradient_boosting", "gb": "gradient_boosting", "gbm": "gradient_boosting",
    "gradientboosting": "gradient_boosting",
    "logistic_regression": "logistic_regression", "lr": "logistic_regression",
    "logisticregression": "logistic_regression",
    "linear_regression": "linear_regression", "linearregression": "linear_regression",
    "decision_tree": "decision_tree", "dt": "decision_tree", "decisiontree": "decision_tree",
    "knn": "knn", "kneighbors": "knn",
    "svm": "svm", "svc": "svm", "svr": "svm",
    "xgboost": "xgboost", "lightgbm": "lightgbm", "catboost": "catboost",
    "voting": "voting", "stacking": "stacking",
}


def canonical(model_type: str) -> str:
    key = model_type.replace("-", "_").replace(" ", "_").lower()
    if key not in ALIASES:
        raise ValueError(f"unknown model type {model_type}")
    return ALIASES[key]


# Parameter names of the common single-table ML vocabulary → pyspark.ml.
PARAM_NAMES = {"n_estimators": "numTrees", "max_depth": "maxDepth",
               "min_samples_leaf": "minInstancesPerNode", "subsample": "subsamplingRate",
               "learning_rate": "stepSize", "max_iter": "maxIter", "max_bins": "maxBins"}


def _translate(est_cls, params: dict, problem: str, n_rows: int | None = None) -> dict:
    out = {}
    for k, v in (params or {}).items():
        name = PARAM_NAMES.get(k, k)
        if k == "n_estimators" and est_cls in (GBTClassifier, GBTRegressor):
            name = "maxIter"
        if k == "C":
            # L2 penalty C (sum of losses) → regParam on the mean loss
            out["regParam"] = 1.0 / (float(v) * max(n_rows or 1, 1))
            continue
        if k == "max_features":
            out["featureSubsetStrategy"] = "all" if v is None else v
            continue
        if k == "criterion":
            out["impurity"] = v
            continue
        if k == "penalty":
            out["elasticNetParam"] = 1.0 if v == "l1" else 0.0
            continue
        if k == "max_depth" and v is None:
            v = 30 if est_cls in (DecisionTreeClassifier, DecisionTreeRegressor) else 20
        if k in ("kernel", "gamma", "degree", "weights", "n_neighbors", "probability"):
            continue
        out[name] = v
    return {k: v for k, v in out.items() if est_cls().hasParam(k)}


PRESETS = {  # documented approximations of optional boosters by GBT settings
    "xgboost": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6},
    "lightgbm": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 8},
    "catboost": {"maxIter": 100, "stepSize": 0.05, "maxDepth": 6},
}


def make_estimator(model_type: str, problem: str, params: dict | None = None,
                   n_classes: int = 2, n_rows: int | None = None, seed: int = 42) -> Estimator:
    mt = canonical(model_type)
    cls = problem.lower().startswith("class")
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if mt == "random_forest":
        c = RandomForestClassifier if cls else RandomForestRegressor
        return c(seed=seed, **common, **{"numTrees": 100} | _translate(c, params, problem))
    if mt in ("gradient_boosting", "xgboost", "lightgbm", "catboost"):
        c = GBTClassifier if cls else GBTRegressor
        p = dict(PRESETS.get(mt, {"maxIter": 100}))
        p.update(_translate(c, params, problem))
        est = c(seed=seed, **common, **p)
        if cls and n_classes > 2:
            return OneVsRest(classifier=c(seed=seed, **p), featuresCol=FEATURES, labelCol=LABEL)
        return est
    if mt == "logistic_regression":
        p = {"maxIter": 1000, "regParam": 1.0 / max(n_rows or 1, 1), "standardization": False,
             "elasticNetParam": 0.0}
        p.update(_translate(LogisticRegression, params, problem, n_rows))
        return LogisticRegression(**common, **p)
    if mt == "linear_regression":
        p = {"solver": "normal", "regParam": 0.0}
        p.update(_translate(LinearRegression, params, problem))
        return LinearRegression(**common, **p)
    if mt == "decision_tree":
        c = DecisionTreeClassifier if cls else DecisionTreeRegressor
        return c(seed=seed, **common, **_translate(c, params, problem))
    raise ValueError(f"{model_type} has no single pyspark.ml estimator")


def feature_stage(features: Sequence[str]) -> Transformer:
    """Coerce every feature to double (non-numeric / null → 0)."""
    exprs = ", ".join(f"coalesce(try_cast(`{c}` AS double), 0.0) AS `_x_{i}`"
                      for i, c in enumerate(features))
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def build_pipeline(features: Sequence[str], model_type: str, problem: str, params=None,
                   n_classes: int = 2, n_rows: int | None = None, label: str | None = None,
                   seed: int = 42) -> Pipeline:
    features = list(features)
    stages = [feature_stage(features)]
    inputs = [f"_x_{i}" for i in range(len(features))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    stages.append(make_estimator(model_type, problem, params, n_classes, n_rows, seed))
    return Pipeline(stages=stages)


#: Learners whose trees may be grown from cells.
TREES = ("decision_tree", "gradient_boosting", *PRESETS)


def _maker(est: Estimator) -> Estimator:
    """The trees' estimator: that of one class against the others has it inside."""
    return est.getClassifier() if isinstance(est, OneVsRest) else est


def _sees_cells(est: Estimator) -> bool:
    """Whether rows that agree in their bins are one to the learner: trees that draw no rows,
    with a loss that is a sum over the rows of a cell."""
    est = _maker(est)
    if isinstance(est, (DecisionTreeClassifier, DecisionTreeRegressor)):
        return True
    return isinstance(est, (GBTClassifier, GBTRegressor)) and est.getSubsamplingRate() == 1.0 and \
        est.getLossType() in ("logistic", "squared")


def feature_cells(train_df: DataFrame, features: Sequence[str], problem: str, max_bins: int = 32) -> Cells:
    """The training rows as cells (:mod:`.binning`), for any number of tree fits."""
    inputs = [f"_x_{i}" for i in range(len(features))]
    ready = feature_stage(features).transform(train_df).select(*inputs, LABEL)
    return cells(ready, inputs, LABEL, problem.lower().startswith("class"), max_bins)


def grove_for(df: DataFrame, features: Sequence[str], model_type: str, problem: str, n_classes: int,
              subsets: Sequence[grove.Subset], made: Sequence[Cells] | None = None) -> grove.Grove | None:
    """The subsets' cells, to grow all their decision trees at once (:mod:`.grove`); None for other
    learners and where cells are not few.  ``made``: the cells that each learns from, if known."""
    if canonical(model_type) != "decision_tree" or not problem.lower().startswith("class"):
        return None
    return grove.plant(feature_stage(features).transform(df), [f"_x_{i}" for i in range(len(features))], LABEL, n_classes, subsets,
                       made and [m.bucketizer for m in made])


def _fit_pipeline(train_df: DataFrame, features: Sequence[str], model_type: str, problem: str, params=None,
                  n_classes: int = 2, n_rows: int | None = None, seed: int = 42, made: Cells | None = None) -> PipelineModel:
    """Fits ``build_pipeline``; trees on the cells of the rows (``made``, if known), binned by a
    stage of the fitted pipeline."""
    features = list(features)
    plain = build_pipeline(features, model_type, problem, params, n_classes, n_rows, seed=seed)
    est = plain.getStages()[-1]
    if isinstance(est, (RandomForestClassifier, RandomForestRegressor)):
        return _fit_forest(train_df, features, problem, plain, made)
    if isinstance(est, LogisticRegression):
        return _fit_logistic(train_df, features, plain)
    if not _sees_cells(est):
        return plain.fit(train_df)
    own = made is None or made.max_bins != _maker(est).getMaxBins()
    if own:
        made = feature_cells(train_df, features, problem, _maker(est).getMaxBins())
    tree = _maker(est)
    least = tree.getMinInstancesPerNode()
    if least > 1:
        # so many rows, which a cell holds by its weight
        share = (least - 0.5) / max(made.n_rows, 1)
        tree.setMinInstancesPerNode(1)
        if share < 0.5:
            tree.setMinWeightFractionPerNode(share)
        else:
            tree.setMaxDepth(0)
    # the bins are found: every cell, not a sample of them, names their borders
    tree.setMaxBins(max(2, tree.getMaxBins() + 1, math.ceil(math.sqrt(made.n_cells)) + 1))
    tree.setWeightCol(WEIGHT)
    if est is not tree:
        est.setClassifier(tree).setWeightCol(WEIGHT)
    assemble = VectorAssembler(inputCols=made.names, outputCol=FEATURES, handleInvalid="keep")
    fitted = est.fit(assemble.transform(made.rows))
    if own:
        made.close()
    return PipelineModel(stages=[feature_stage(features), made.bucketizer, assemble, fitted])


def _fit_forest(train_df: DataFrame, features: list[str], problem: str, plain: Pipeline, made: Cells | None) -> PipelineModel:
    """A forest on cells (:mod:`.forest`); on the rows, where cells are not many times fewer."""
    est = plain.getStages()[-1]
    own = made is None or made.max_bins != est.getMaxBins()
    if own:
        made = feature_cells(train_df, features, problem, est.getMaxBins())
    if forest.pays(made):
        stages = [feature_stage(features), made.bucketizer]
        binned = PipelineModel(stages=stages).transform(train_df).select(*made.names, LABEL)
        fitted = PipelineModel(stages=[*stages, VectorAssembler(inputCols=made.names, outputCol=FEATURES, handleInvalid="keep"),
                                       forest.fit_forest(est, made, binned, LABEL, FEATURES)])
    else:
        fitted = None
    if own:
        made.close()
    return fitted or plain.fit(train_df)


def _fit_logistic(train_df: DataFrame, features: list[str], plain: Pipeline) -> PipelineModel:
    """The loss is a sum over rows: rows that agree in all features and their class count as one
    with their number as weight, where these are many times fewer than the rows."""
    inputs = [f"_x_{i}" for i in range(len(features))]
    ready = feature_stage(features).transform(train_df).select(*inputs, LABEL)
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*inputs, LABEL)).alias("kinds")).first()
    if size["kinds"] * forest.ROWS_A_CELL > size["n"]:
        return plain.fit(train_df)
    rows = ready.groupBy(*inputs, LABEL).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    # few partitions of a fixed order: many short jobs follow, and reruns add up alike
    rows = rows.repartition(math.ceil(size["kinds"] / PART), *inputs).sortWithinPartitions(*inputs, LABEL).cache()
    first, assemble, est = plain.getStages()
    fitted = est.setWeightCol(WEIGHT).fit(assemble.transform(rows))
    rows.unpersist()
    return PipelineModel(stages=[first, assemble, fitted])


def prepare_label(df: DataFrame, label: str, problem: str):
    """Classification labels → 0..k−1 doubles (alphabetical); regression → double.
    Rows with a null label have no class and are left out."""
    d = df.where(F.col(label).isNotNull())
    if problem.lower().startswith("class"):
        distinct = d.select(F.col(label).cast("string")).distinct().limit(MAX_CLASSES + 1).collect()
        if len(distinct) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes: not a classification target")
        classes = sorted(r[0] for r in distinct)
        mapping = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        return d.withColumn(LABEL, mapping[F.col(label).cast("string")]), classes
    return d.withColumn(LABEL, F.col(label).cast("double")), None


def score(pred: DataFrame, problem: str) -> dict:
    if problem.lower().startswith("class"):
        m = EV.class_metrics(pred, LABEL, PRED)
        return {"accuracy": m["accuracy"], "f1_macro": m["f1_macro"],
                "balanced_accuracy": m["balanced_accuracy"], "mcc": m["mcc"]}
    y, p = F.col(LABEL), F.col(PRED)
    r = pred.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.var_pop(y).alias("vy")).first()
    r2 = 1 - r["mse"] / r["vy"] if r["vy"] else 0.0
    return {"rmse": math.sqrt(r["mse"]), "mae": r["mae"], "r2": r2}


def primary(problem: str) -> str:
    return "accuracy" if problem.lower().startswith("class") else "r2"


class Ensemble:
    """Voting / stacking over fitted base pipelines (rf + gb + lr)."""

    def __init__(self, kind: str, bases: list[PipelineModel], problem: str, classes=None,
                 final: PipelineModel | None = None, voting: str = "soft", n_classes: int = 0):
        self.n_classes = n_classes
        self.kind, self.bases, self.problem = kind, bases, problem
        self.classes, self.final, self.voting = classes, final, voting

    def _base_preds(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.bases):
            t = m.transform(out)
            col = PRED
            if self.problem.lower().startswith("class") and "probability" in t.columns \
                    and (self.kind == "stacking" or self.voting == "soft"):
                t = t.withColumn(f"_p{i}", vector_to_array("probability"))
            else:
                t = t.withColumn(f"_p{i}", F.col(col))
            out = t.drop(*[c for c in t.columns if c in ("rawPrediction", "probability", PRED,
                                                         FEATURES) or c.startswith("_x_")])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        t = self._base_preds(df)
        k = len(self.bases)
        cls = self.problem.lower().startswith("class")
        if self.kind == "stacking":
            return self.final.transform(_meta_features(t, k, self.n_classes))
        if not cls:
            return t.withColumn(PRED, sum(F.col(f"_p{i}") for i in range(k)) / k)
        is_arr = [t.schema[f"_p{i}"].dataType.simpleString().startswith("array")
                  for i in range(k)]
        if self.voting == "soft" and all(is_arr):
            avg = F.zip_with(F.col("_p0"), F.col("_p1"), lambda a, b: a + b)
            for i in range(2, k):
                avg = F.zip_with(avg, F.col(f"_p{i}"), lambda a, b: a + b)
            return t.withColumn("probability", F.transform(avg, lambda p: p / k)) \
                .withColumn(PRED, F.array_position(avg, F.array_max(avg)).cast("double") - 1)
        # a base without class probabilities: probability rows become class votes
        for i in range(k):
            if is_arr[i]:
                t = t.withColumn(f"_p{i}", (F.array_position(F.col(f"_p{i}"), F.array_max(
                    F.col(f"_p{i}"))) - 1).cast("double"))
        votes = F.array(*[F.col(f"_p{i}") for i in range(k)])
        # hard vote: most frequent prediction, ties → smallest class index
        best = F.aggregate(F.array_distinct(votes), F.struct(F.lit(-1).alias("c"),
                                                             F.lit(1e9).alias("v")),
                           lambda acc, v: F.when(
                               (F.size(F.filter(votes, lambda x: x == v)) > acc["c"]) |
                               ((F.size(F.filter(votes, lambda x: x == v)) == acc["c"]) &
                                (v < acc["v"])),
                               F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("c"),
                                        v.alias("v"))).otherwise(acc))
        return t.withColumn(PRED, best["v"])


def _is_array(t: DataFrame, i: int) -> bool:
    return t.schema[f"_p{i}"].dataType.simpleString().startswith("array")


def _meta_features(t: DataFrame, k: int, n_classes: int) -> DataFrame:
    """Columns a stacked model learns from: each base's class probabilities (the first
    is what the others leave) or, where it has none, its prediction."""
    return t.select("*", *[F.get(F.col(f"_p{i}"), j).alias(f"_p{i}_{j}") for i in range(k)
                           if _is_array(t, i) for j in range(1, n_classes)])


def _meta_columns(t: DataFrame, k: int, n_classes: int) -> list[str]:
    return [c for i in range(k) for c in (
        [f"_p{i}_{j}" for j in range(1, n_classes)] if _is_array(t, i) else [f"_p{i}"])]


def _fit_one(train_df, features, model_type, problem, params, n_classes, seed, only_score=False, made=None):
    """Fit on the rows given.  The penalty ``C`` counts losses, Spark's their mean:
    models that take it need the number of training rows.  ``only_score``: class
    probabilities that cost fits of their own are left out.  ``made``: the rows as cells."""
    mt = canonical(model_type)
    n_rows = train_df.count() if mt in ("logistic_regression", "voting", "stacking") else None
    if mt == "svm":
        from .svm import fit_svm
        more = {"probability": False} if only_score else {}
        return fit_svm(train_df, [feature_stage(features)], [f"_x_{i}" for i in range(len(features))], LABEL, problem,
                       {**(params or {}), **more}, n_classes, seed, PRED)
    if mt == "knn":
        from .neighbors import KNNModel
        return KNNModel(features, (params or {}).get("n_neighbors", 5),
                        (params or {}).get("weights", "uniform"), problem, n_classes).fit(train_df)
    if mt in ("voting", "stacking"):
        bases = [_fit_pipeline(train_df, features, m, problem, None, n_classes, n_rows, seed)
                 for m in ("random_forest", "gradient_boosting",
                                          "logistic_regression" if problem.lower().startswith(
                                              "class") else "linear_regression")]
        if mt == "voting":
            return Ensemble("voting", bases, problem, voting=(params or {}).get("voting", "soft"))
        # stacking: out-of-fold class probabilities (regression: predictions) → final
        # logistic / linear model; folds by the row key, fixed by a checkpoint
        if "_row_key" not in train_df.columns:
            raise ValueError("stacking needs a row key for its folds")
        folds, k = assign_folds(train_df, "_row_key", "kfold", 5)
        folds = cut(folds)
        base_types = ("random_forest", "gradient_boosting",
                      "logistic_regression" if problem.lower().startswith("class")
                      else "linear_regression")

        def fold_preds(f):
            tr, te = folds.where(F.col(FOLD) != f), folds.where(F.col(FOLD) == f)
            ms = [_fit_pipeline(tr, features, m, problem, None, n_classes, n_rows, seed) for m in base_types]
            return Ensemble("stacking", ms, problem)._base_preds(te)

        with ThreadPoolExecutor(max_workers=k) as ex:
            parts = list(ex.map(fold_preds, range(k)))
        oof = parts[0]
        for part in parts[1:]:
            oof = oof.unionByName(part)
        final_type = "logistic_regression" if problem.lower().startswith("class") else \
            "linear_regression"
        final = build_pipeline(_meta_columns(oof, len(base_types), n_classes), final_type, problem,
                               None, n_classes, n_rows, seed=seed).fit(
            _meta_features(oof, len(base_types), n_classes))
        return Ensemble("stacking", bases, problem, final=final, n_classes=n_classes)
    return _fit_pipeline(train_df, features, model_type, problem, params, n_classes, n_rows, seed, made)


def train(df: DataFrame, features: Sequence[str], label: str, model_type: str = "random_forest",
          problem: str = "classification", params: dict | None = None, key: str | None = None,
          cv: str = "none", folds: int = 5, test_size: float = 0.2, seed: int = 42):
    """Fit on the train split, score the test split, optionally cross-validate.

    ``df`` may carry a ``split`` column (train/test); otherwise one is made by
    a seeded hash of ``key`` (stratified for classification).
    Returns ``(model, metrics, cv_df, classes)``.
    """
    from .split import split_random, split_stratified
    d, classes = prepare_label(df, label, problem)
    if "split" not in d.columns:
        if key is None:
            raise ValueError("a key column (or a split column) is required")
        d = split_stratified(d, key, label, test_size, seed) if classes else \
            split_random(d, key, test_size, seed)
    d = d.cache()
    train_df = d.where(F.col("split") == "train")
    test_df = d.where(F.col("split") == "test")
    n_classes = len(classes) if classes else 0
    if key is not None:
        train_df = train_df.withColumn("_row_key", F.col(key))
    model = _fit_one(train_df, features, model_type, problem, params, n_classes, seed)
    metrics = score(model.transform(test_df), problem)
    metrics["train_" + primary(problem)] = score(model.transform(train_df), problem)[primary(problem)]
    cv_df = None
    if cv != "none" and key is not None:
        cv_df = cross_val_score(train_df.drop("split"), features, model_type, problem, params,
                                key, cv, folds, n_classes, seed)
        cv_df = d.sparkSession.createDataFrame(cv_df.collect(), cv_df.schema)
    d.unpersist()   # metrics and fold scores are already computed
    return model, metrics, cv_df, classes


def cross_val_score(d: DataFrame, features, model_type, problem, params, key, method="kfold",
                    k=5, n_classes=2, seed=42, order=None) -> DataFrame:
    """Per-fold score (accuracy or r2); folds fitted concurrently."""
    fd, kk = assign_folds(d, key, method, k, label=LABEL if problem.lower().startswith("class")
                          else None, order=order, seed=seed)
    fd = fd.withColumn("_row_key", F.col(key)).cache()
    if method == "timeseries":
        pairs = [(fd.where(F.col(FOLD) < f), fd.where(F.col(FOLD) == f)) for f in range(kk)]
    else:
        pairs = [(fd.where(F.col(FOLD) != f), fd.where(F.col(FOLD) == f)) for f in range(kk)]

    def run(i):
        tr, te = pairs[i]
        m = _fit_one(tr, features, model_type, problem, params, n_classes, seed, only_score=True)
        return i, score(m.transform(te), problem)[primary(problem)]

    with ThreadPoolExecutor(max_workers=min(kk, 4)) as ex:
        res = sorted(ex.map(run, range(kk)))
    fd.unpersist()
    return d.sparkSession.createDataFrame([(i, float(s)) for i, s in res],
                                          f"fold int, {primary(problem)} double")


def cv_summary(cv_df: DataFrame) -> dict:
    col = [c for c in cv_df.columns if c != "fold"][0]
    r = cv_df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    return {"cv_mean": r["m"], "cv_std": r["s"]}


def compare_models(df: DataFrame, features, label, problem="classification",
                   model_types=("random_forest", "gradient_boosting", "logistic_regression",
                                "decision_tree"), key=None, params=None, seed=42) -> DataFrame:
    """Train each model type (concurrently), rank by accuracy / r2 descending;
    failures are reported with their error text, not raised."""
    from .split import split_random, split_stratified
    d, classes = prepare_label(df, label, problem)
    d = (split_stratified(d, key, label, 0.2, seed) if classes else
         split_random(d, key, 0.2, seed)).withColumn("_row_key", F.col(key)).cache()
    tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    metric = primary(problem)

    def run(mt):
        try:
            m = _fit_one(tr, features, mt, problem, (params or {}).get(mt), len(classes or []), seed, only_score=True)
            s = score(m.transform(te), problem)
            return (mt, float(s[metric]), None)
        except Exception as exc:  # noqa: BLE001 - reported per model
            return (mt, None, str(exc)[:500])

    with ThreadPoolExecutor(max_workers=4) as ex:
        rows = list(ex.map(run, model_types))
    d.unpersist()
    ok = sorted([r for r in rows if r[1] is not None], key=lambda r: -r[1])
    bad = [r for r in rows if r[1] is None]
    out = [(i + 1, *r) for i, r in enumerate(ok)] + [(None, *r) for r in bad]
    return df.sparkSession.createDataFrame(out, f"rank int, model_type string, {metric} double, "
                                                "error string")


def predict(model, df: DataFrame, classes=None) -> DataFrame:
    """Score a batch or streaming DataFrame; class indices mapped back to labels.
    ``class_probabilities`` holds one number per class where the model has them, null
    otherwise."""
    out = model.transform(df)
    kinds = dict(out.dtypes)
    if kinds.get("probability") == "vector":
        proba = vector_to_array("probability")
    elif kinds.get("probability", "").startswith("array"):
        proba = F.col("probability")
    else:
        proba = F.lit(None).cast("array<double>")
    out = out.withColumn("class_probabilities", proba)
    if classes:
        out = out.withColumn("predicted_label", F.element_at(
            F.array(*[F.lit(c) for c in classes]), F.col(PRED).cast("int") + 1))
    return out


def feature_importance(model, features: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """Model importances, or mean |coefficient| over classes for linear models."""
    est = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray()
    elif hasattr(est, "coefficientMatrix"):
        vals = np.abs(est.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(est, "coefficients"):
        vals = np.abs(est.coefficients.toArray())
    else:
        return []
    pairs = sorted(zip(features, [float(v) for v in vals[:len(features)]]), key=lambda p: -p[1])
    return pairs[:top]


def learning_curve(df: DataFrame, features, label, model_type="random_forest",
                   problem="classification", key=None, k=5,
                   fractions=tuple(i / 10 for i in range(1, 11)), seed=42) -> DataFrame:
    """Mean train and test score per training fraction over k folds, plus the
    diagnosis on the largest fraction.  Fold × fraction fits run concurrently; decision trees
    are grown together where their cells are few."""
    d, classes = prepare_label(df, label, problem)
    fd, kk = assign_folds(d, key, "stratified" if classes else "kfold", k,
                          label=LABEL if classes else None, seed=seed)
    fd = fd.withColumn("_u", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 7)), F.lit(10 ** 6))
                       / 1e6).withColumn("_row_key", F.col(key)).cache()
    jobs = [(f, fr) for fr in fractions for f in range(kk)]

    together = grove_for(fd, features, model_type, problem, len(classes or []),
                         [grove.Subset((F.col(FOLD) != f) & (F.col("_u") < fr), F.col(FOLD) == f) for f, fr in jobs])
    known = {}
    if together is not None:
        one = grove.setting(None)
        known = {jobs[i]: scores for (i, _), scores in together.scores([one]).items()}
        together.close()

    def run(job):
        f, fr = job
        if job in known:
            return fr, *known[job]
        tr = fd.where((F.col(FOLD) != f) & (F.col("_u") < fr))
        te = fd.where(F.col(FOLD) == f)
        m = _fit_one(tr, features, model_type, problem, None, len(classes or []), seed, only_score=True)
        met = primary(problem)
        return fr, score(m.transform(tr), problem)[met], score(m.transform(te), problem)[met]

    with ThreadPoolExecutor(max_workers=4) as ex:
        res = list(ex.map(run, jobs))
    fd.unpersist()
    rows = []
    for fr in fractions:
        sel = [r for r in res if r[0] == fr]
        rows.append((float(fr), float(np.mean([r[1] for r in sel])),
                     float(np.mean([r[2] for r in sel]))))
    diag = EV.diagnose(rows[-1][1], rows[-1][2])
    return df.sparkSession.createDataFrame(
        [(*r, diag) for r in rows], "fraction double, train_score double, test_score double, "
                                    "diagnosis string")
