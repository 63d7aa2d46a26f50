"""Learner, tuning, explanation, clustering and neighbour queries (§2.9, §2.11–2.15).

Model fits are checked rows-only (plus invariant tests); DBSCAN, cluster
indices, cluster sizes and SMOTE class counts have SQL oracles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import explain as EX
from ..operators import learners as L
from ..operators import neighbors as NB
from ..operators import tune as TU
from ..session import ensure_checkpoint_dir
from ..sources import files
from ..sources.models import ModelStore
from . import query
from .tables import round_doubles, table

LI_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lineitem_cls(spark, sf):
    """Planted signal: a large line is one with extended price above 25,000."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("li_key"),
                     *LI_FEATS, (F.col("l_extendedprice") > 25000).cast("int").alias("big"),
                     "l_extendedprice")


def labels_cls(spark, sf):
    """Labelled documents: toxicity from length features and quality."""
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select("doc_id", "toxic", "quality", "n_chars",
                                           F.log1p("n_chars").alias("len_log"))


def customer_cls(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey",
                                               "c_mktsegment")


def _test_predictions(model, spark, df, key, label, problem):
    d, _ = L.prepare_label(df, label, problem)
    from ..operators.split import split_random, split_stratified
    d = split_stratified(d, key, label, 0.2, 42) if problem == "classification" else \
        split_random(d, key, 0.2, 42)
    return model.transform(d.where(F.col("split") == "test")).select(
        key, F.col(L.LABEL).alias("label"), F.col(L.PRED).cast("double").alias("prediction"))


def _train_query(model_type, problem="classification", params=None, source="lineitem"):
    def fn(spark, sf):
        if source == "lineitem":
            df, key, feats = lineitem_cls(spark, sf), "li_key", LI_FEATS
            label = "big" if problem == "classification" else "l_extendedprice"
        elif source == "labels":
            df, key, feats, label = labels_cls(spark, sf), "doc_id", \
                ["n_chars", "len_log", "quality"], "toxic"
        else:
            df, key, feats, label = customer_cls(spark, sf), "c_custkey", \
                ["c_acctbal", "c_nationkey"], "c_mktsegment"
        model, _, _, _ = L.train(df, feats, label, model_type, problem, params, key=key)
        return _test_predictions(model, spark, df, key, label, problem)
    return fn


query("train_random_forest")(_train_query("random_forest"))
query("train_gradient_boosting")(_train_query("gradient_boosting"))
query("train_logistic_regression")(_train_query("logistic_regression"))
query("train_linear_regression")(_train_query("linear_regression", "regression"))
query("train_decision_tree")(_train_query("decision_tree", params={"max_depth": 5}))
query("train_random_forest_regression")(_train_query("random_forest", "regression"))
query("train_svm")(_train_query("svm"))
query("train_svm_rbf")(_train_query("svm", params={"kernel": "rbf"}, source="labels"))
query("train_svm_poly")(_train_query("svm", params={"kernel": "poly"}, source="labels"))
query("train_xgboost_preset")(_train_query("xgboost"))
query("train_lightgbm_preset")(_train_query("lightgbm"))
query("train_catboost_preset")(_train_query("catboost"))
query("train_knn")(_train_query("knn", params={"n_neighbors": 5}, source="customer"))
query("train_voting")(_train_query("voting", source="labels"))
query("train_stacking")(_train_query("stacking", source="labels"))


@query("predict_saved_model")
def predict_saved_model(spark, sf):
    """Train, save as a PipelineModel with metadata, load, and score the whole table."""
    df = lineitem_cls(spark, sf)
    model, metrics, _, classes = L.train(df, LI_FEATS, "big", "decision_tree", "classification",
                                         {"max_depth": 5}, key="li_key")
    root = files.join(ensure_checkpoint_dir(spark), "models")
    store = ModelStore(spark, root)
    mid = store.save(model, "decision_tree", "classification", LI_FEATS, "big", {"max_depth": 5},
                     metrics, model_id=uuid.uuid4().hex)
    loaded, meta = store.load(mid)
    return L.predict(loaded, df, classes).select("li_key", "prediction", "predicted_label")


@query("cross_val_score")
def cross_val_score(spark, sf):
    df = lineitem_cls(spark, sf)
    d, classes = L.prepare_label(df, "big", "classification")
    return L.cross_val_score(d, LI_FEATS, "decision_tree", "classification", {"max_depth": 5},
                             "li_key", "stratified", n_classes=len(classes))


@query("compare_models")
def compare_models(spark, sf):
    return L.compare_models(lineitem_cls(spark, sf), LI_FEATS, "big", "classification",
                            key="li_key")


@query("learning_curve")
def learning_curve(spark, sf):
    return L.learning_curve(customer_cls(spark, sf), ["c_acctbal", "c_nationkey"],
                            "c_mktsegment", "decision_tree", "classification", "c_custkey")


@query("feature_importance")
def feature_importance(spark, sf):
    df = lineitem_cls(spark, sf)
    model, *_ = L.train(df, LI_FEATS, "big", "random_forest", "classification",
                        key="li_key")
    return spark.createDataFrame(L.feature_importance(model, LI_FEATS),
                                 "feature string, importance double")


@query("grid_search")
def grid_search(spark, sf):
    _, _, trials = TU.search(customer_cls(spark, sf), ["c_acctbal", "c_nationkey"],
                             "c_mktsegment", "decision_tree", "classification", "c_custkey",
                             "grid")
    return trials


@query("random_search")
def random_search(spark, sf):
    _, _, trials = TU.search(customer_cls(spark, sf), ["c_acctbal", "c_nationkey"],
                             "c_mktsegment", "decision_tree", "classification", "c_custkey",
                             "random")
    return trials


@query("bayesian_search")
def bayesian_search(spark, sf):
    _, _, trials = TU.search(customer_cls(spark, sf), ["c_acctbal", "c_nationkey"],
                             "c_mktsegment", "decision_tree", "classification", "c_custkey",
                             "bayesian")
    return trials


@query("shap_importance")
def shap_importance(spark, sf):
    df = lineitem_cls(spark, sf)
    model, *_ = L.train(df, LI_FEATS, "big", "logistic_regression", "classification",
                        key="li_key")
    return EX.shap_importance(model, df, LI_FEATS)


@query("lime_explain")
def lime_explain(spark, sf):
    df = customer_cls(spark, sf)
    model, *_ = L.train(df, ["c_acctbal", "c_nationkey"], "c_mktsegment", "decision_tree",
                        "classification", {"max_depth": 4}, key="c_custkey")
    return EX.lime_explain(model, df, ["c_acctbal", "c_nationkey"], "c_custkey")


# ---- clustering -------------------------------------------------------------
EMB_DIMS = 64


def embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                         for i in range(EMB_DIMS)])


EMB_COLS = [f"e{i}" for i in range(EMB_DIMS)]

for _m in ("kmeans", "bisecting", "hierarchical", "spectral"):
    def _fn(spark, sf, _m=_m):
        return CL.cluster(embeddings(spark, sf), EMB_COLS, "vec_id", _m, k=10).select(
            "vec_id", "label", "cluster")
    query(f"cluster_{_m}")(_fn)


@query("optimal_k")
def optimal_k(spark, sf):
    return CL.optimal_k(embeddings(spark, sf), EMB_COLS, max_k=6)


@query("pca")
def pca(spark, sf):
    scores, ratios = CL.pca(embeddings(spark, sf), EMB_COLS, "vec_id", 2)
    return scores


DB_SQL = """WITH RECURSIVE p AS (SELECT c_custkey AS k, c_acctbal / CAST(1000 AS DOUBLE) AS x1,
  CAST(c_nationkey AS DOUBLE) / CAST(2 AS DOUBLE) AS x2 FROM customer),
pairs AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b
  ON (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= 0.25),
cnt AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
core AS (SELECT a AS k FROM cnt WHERE n >= 5),
edges AS (SELECT a, b FROM pairs WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)
  AND a <> b),
reach(k, r) AS (SELECT k, k FROM core UNION SELECT e.b, reach.r FROM reach JOIN edges e
  ON reach.k = e.a),
comp AS (SELECT k, min(r) AS comp FROM reach GROUP BY k),
ids AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster
  FROM (SELECT DISTINCT comp FROM comp)),
corelab AS (SELECT comp.k, ids.cluster FROM comp JOIN ids USING (comp)),
border AS (SELECT pairs.a AS k, min(corelab.cluster) AS cluster FROM pairs
  JOIN corelab ON pairs.b = corelab.k WHERE pairs.a NOT IN (SELECT k FROM core) GROUP BY pairs.a),
lab AS (SELECT * FROM corelab UNION ALL SELECT * FROM border)
SELECT c_custkey, CAST(coalesce(lab.cluster, -1) AS INTEGER) AS cluster
FROM customer LEFT JOIN lab ON customer.c_custkey = lab.k"""


@query("dbscan", DB_SQL)
def dbscan(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / F.lit(1000.0)).alias("x1"),
        (F.col("c_nationkey").cast("double") / F.lit(2.0)).alias("x2"))
    return NB.dbscan(c, "c_custkey", ["x1", "x2"], eps=0.5, min_samples=5) \
        .select("c_custkey", F.col("cluster").cast("int"))


@query("cluster_sizes", """SELECT c_mktsegment AS cluster, count(*) AS size FROM customer
GROUP BY 1""")
def cluster_sizes(spark, sf):
    return CL.cluster_sizes(customer_cls(spark, sf), "c_mktsegment")


CM_SQL = """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS c, c_acctbal AS x1,
  CAST(c_nationkey AS DOUBLE) AS x2 FROM customer),
s AS (SELECT c, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1 + x2 * x2) AS q
  FROM p GROUP BY c),
g AS (SELECT sum(s1) / sum(n) AS m1, sum(s2) / sum(n) AS m2, sum(n) AS n, count(*) AS k FROM s),
t AS (SELECT p.id, p.c AS own, s.c AS oc, s.n,
  (p.x1 * p.x1 + p.x2 * p.x2) * s.n - 2 * (p.x1 * s.s1 + p.x2 * s.s2) + s.q AS tot FROM p, s),
sil AS (SELECT id, max(CASE WHEN own = oc THEN tot / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN own <> oc THEN tot / n END) AS b FROM t GROUP BY id),
ch AS (SELECT sum(s.n * ((s.s1 / s.n - g.m1) * (s.s1 / s.n - g.m1)
    + (s.s2 / s.n - g.m2) * (s.s2 / s.n - g.m2))) AS bw,
  sum(s.q - (s.s1 * s.s1 + s.s2 * s.s2) / s.n) AS ww, any_value(g.n) AS n, any_value(g.k) AS k
  FROM s, g),
dd AS (SELECT p.c, avg(sqrt((p.x1 - s.s1 / s.n) * (p.x1 - s.s1 / s.n)
  + (p.x2 - s.s2 / s.n) * (p.x2 - s.s2 / s.n))) AS sc FROM p JOIN s ON p.c = s.c GROUP BY p.c),
db AS (SELECT avg(w) AS v FROM (SELECT a.c, max((da.sc + db.sc) / sqrt(
    (a.s1 / a.n - b.s1 / b.n) * (a.s1 / a.n - b.s1 / b.n)
  + (a.s2 / a.n - b.s2 / b.n) * (a.s2 / a.n - b.s2 / b.n))) AS w
  FROM s a JOIN s b ON a.c <> b.c JOIN dd da ON da.c = a.c JOIN dd db ON db.c = b.c GROUP BY a.c))
SELECT 'silhouette_sq' AS metric, round(avg((b - a) / greatest(a, b)), 4) AS value FROM sil
UNION ALL SELECT 'calinski_harabasz', round(bw * (n - k) / (ww * (k - 1)), 4) FROM ch
UNION ALL SELECT 'davies_bouldin', round(v, 4) FROM db"""


@query("cluster_metrics", CM_SQL)
def cluster_metrics(spark, sf):
    c = customer_cls(spark, sf)
    return round_doubles(CL.cluster_metrics(c, ["c_acctbal", "c_nationkey"], "c_mktsegment"), 4)


def _labels_docs(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select("doc_id", "toxic", "n_chars",
                                           F.log1p("n_chars").alias("len_log"))


@query("balance_smote", """WITH c AS (SELECT toxic, count(*) AS n FROM labels
  WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1)
SELECT toxic, (SELECT max(n) FROM c) AS n_rows FROM c""")
def balance_smote(spark, sf):
    out = NB.smote(_labels_docs(spark, sf), "toxic", "doc_id", ["n_chars", "len_log"])
    return out.groupBy("toxic").agg(F.count(F.lit(1)).alias("n_rows"))


@query("balance_adasyn")
def balance_adasyn(spark, sf):
    out = NB.adasyn(_labels_docs(spark, sf), "toxic", "doc_id", ["n_chars", "len_log"])
    return out.groupBy("toxic", "_synthetic").agg(F.count(F.lit(1)).alias("n_rows"))


@query("knn_neighbors", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS p,
    list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT q, p, d2, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS nn_rank FROM d)
SELECT q, p, nn_rank::INTEGER AS nn_rank, round(sqrt(d2), 6) AS distance FROM r WHERE nn_rank <= 5""")
def knn_neighbors(spark, sf):
    """Exact 5 nearest embeddings of every embedding."""
    e = embeddings(spark, sf)
    return round_doubles(NB.knn_pairs(e, e, "vec_id", EMB_COLS, 5).select(
        "q", "p", "nn_rank", F.sqrt("d2").alias("distance")), 6)


@query("loo_linear", """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
    regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey * 10 + l_linenumber AS li_key, round(l_extendedprice - (l_extendedprice - my - b * (l_quantity - mx))
    / (1 - 1.0 / n - (l_quantity - mx) * (l_quantity - mx) / sxx), 2) AS loo_prediction FROM lineitem, s""")
def loo_linear(spark, sf):
    """Every line's price by a line through all others."""
    from ..operators.loo import loo_linear as run
    return round_doubles(run(lineitem_cls(spark, sf), ["l_quantity"], "l_extendedprice").select("li_key", "loo_prediction"), 2)


@query("loo_knn", """WITH p AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer),
r AS (SELECT a.c_custkey AS q, b.c_nationkey AS y, row_number() OVER (PARTITION BY a.c_custkey
    ORDER BY (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal), b.c_custkey) AS k
  FROM p a JOIN p b ON a.c_custkey <> b.c_custkey),
v AS (SELECT q, avg(y) AS m FROM r WHERE k <= 5 GROUP BY q)
SELECT q AS c_custkey, round(m, 6) AS loo_prediction FROM v""")
def loo_knn(spark, sf):
    """Every customer's nation number by the five others nearest in balance, ties by key."""
    from ..operators.loo import loo_knn as run
    c = customer_cls(spark, sf)
    return round_doubles(run(c, ["c_acctbal"], "c_nationkey", 5, "regression", key="c_custkey").select("c_custkey", "loo_prediction"), 6)


@query("cluster_hdbscan")
def cluster_hdbscan(spark, sf):
    return CL.cluster(embeddings(spark, sf), EMB_COLS, "vec_id", "hdbscan").select("vec_id", "label", "cluster", "probability")


@query("umap")
def umap(spark, sf):
    """Two coordinates of every embedding that keep its neighbours."""
    from ..operators.umap import umap as run
    return round_doubles(run(embeddings(spark, sf), "vec_id", EMB_COLS), 4)


query("train_svm_regression")(_train_query("svm", "regression", {"kernel": "linear"}))
query("train_svm_linear")(_train_query("svm", params={"kernel": "linear"}))


@query("kernel_shap")
def kernel_shap(spark, sf):
    """Exact Shapley values of a decision tree for every lineitem row."""
    df = lineitem_cls(spark, sf)
    model, *_ = L.train(df, LI_FEATS, "big", "decision_tree", "classification",
                        {"max_depth": 5}, key="li_key")
    return EX.shap_summary(EX.kernel_shap(model, df, LI_FEATS, "li_key"))


# ---- facts of fitted models that SQL can state ---------------------------------
def _line_fit(spark, sf):
    df = lineitem_cls(spark, sf)
    d, _ = L.prepare_label(df, "l_extendedprice", "regression")
    model = L.build_pipeline(["l_quantity"], "linear_regression", "regression").fit(d)
    return df, model


@query("linear_regression_fit", """SELECT 'intercept' AS term,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def linear_regression_fit(spark, sf):
    _, model = _line_fit(spark, sf)
    est = model.stages[-1]
    return round_doubles(spark.createDataFrame(
        [("intercept", float(est.intercept)), ("l_quantity", float(est.coefficients[0]))],
        "term string, coefficient double"), 4)


@query("shap_linear", """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS x FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(b * (l_quantity - x))), 4) AS mean_abs_shap,
  'linear_exact' AS method FROM lineitem, m""")
def shap_linear(spark, sf):
    df, model = _line_fit(spark, sf)
    return round_doubles(EX.shap_importance(model, df, ["l_quantity"]), 4)


@query("pca_variance", """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r""")
def pca_variance(spark, sf):
    _, ratios = CL.pca(lineitem_cls(spark, sf), ["l_quantity", "l_extendedprice"], "li_key", 2)
    return round_doubles(spark.createDataFrame(
        [(k + 1, r) for k, r in enumerate(ratios)], "component int, ratio double"), 6)


@query("knn_by_group", """WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer),
r AS (SELECT a.c_nationkey, a.c_custkey AS q, b.c_custkey AS p, row_number() OVER (
    PARTITION BY a.c_custkey ORDER BY (a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal), b.c_custkey) AS nn_rank
  FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey)
SELECT c_nationkey, q, p, CAST(nn_rank AS INTEGER) AS nn_rank FROM r WHERE nn_rank <= 3""")
def knn_by_group(spark, sf):
    """Exact 3 nearest customers by balance within the nation."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return NB.knn_pairs(c, c, "c_custkey", ["c_acctbal"], 3, by=["c_nationkey"]) \
        .select("c_nationkey", "q", "p", "nn_rank")


@query("one_class_svm_share", "SELECT CAST(floor(0.1 * (count(*) - 1)) + 1 AS BIGINT) AS flagged FROM customer")
def one_class_svm_share(spark, sf):
    """ν = 0.1 flags the rows below the ν-quantile of the decision values."""
    from ..operators.anomaly import one_class_svm
    out = one_class_svm(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey", nu=0.1)
    return out.where("is_anomaly").agg(F.count(F.lit(1)).alias("flagged"))
