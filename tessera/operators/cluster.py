"""Clustering, cluster-quality indices and dimension reduction.

Inputs are standardised first (population std).  k-means and bisecting
k-means are ``pyspark.ml``; Ward clustering agglomerates at most ``m``
weighted k-means micro-clusters (exact grouping when rows ≤ m); spectral
clustering is power iteration (Lin & Cohen 2010) on exact k-NN affinity
edges; DBSCAN is the join-based operator in :mod:`neighbors`, HDBSCAN that of :mod:`hdbscan`.

Quality indices come from per-cluster aggregates (count, Σx, Σ‖x‖²) — O(n·k),
never all pairs.  The silhouette is the squared-Euclidean form that these
aggregates give exactly (``silhouette_sq``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric
from ..plans.lineage import cut
from .scale import fit_scale

VEC, ROW = "_features", "_row_number"


def standardized(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    spec = fit_scale(df, list(cols), "standard")
    return df.select(*keep, *[coerce_numeric(spec.expr(c)).alias(c) for c in cols])


def _vec(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=VEC).transform(df)


def _ward(centers: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of weighted points down to k groups → group per point.  Each
    step merges the cheapest pair of the whole table of costs."""
    c, w = centers.astype(float).copy(), weights.astype(float).copy()
    group = np.arange(len(c))
    alive = np.ones(len(c), bool)

    def costs(i):
        d = ((c - c[i]) ** 2).sum(1) * (w * w[i] / (w + w[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    table = np.stack([costs(i) for i in range(len(c))])
    for _ in range(len(c) - k):
        a, b = sorted(divmod(int(table.argmin()), len(c)))
        c[a] = (c[a] * w[a] + c[b] * w[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
        group[group == b] = a
        table[b], table[:, b] = np.inf, np.inf
        table[a] = costs(a)
        table[:, a] = table[a]
    return np.unique(group, return_inverse=True)[1]


def cluster(df: DataFrame, cols: Sequence[str], key: str, method: str = "kmeans", k: int = 3,
            seed: int = 42, eps: float = 0.5, min_samples: int = 5, micro: int = 200,
            n_neighbors: int = 10, min_cluster_size: int = 5) -> DataFrame:
    """Adds ``cluster`` to ``df`` (and ``probability``, with ``hdbscan``).  Rows are numbered
    first, so rows that repeat a ``key``, or have none, are rows of their own.

    ``micro``: k-means centres that ``hierarchical`` merges (at most one for each row)."""
    cols = list(cols)
    rows = cut(df.withColumn(ROW, F.monotonically_increasing_id()))
    n = rows.count()
    k = max(1, min(k, n - 1))
    z = standardized(rows, cols, keep=[ROW])
    found = _clustered(rows, z, cols, key, method, k, seed, eps, min_samples, micro, n_neighbors, min_cluster_size, n)
    return rows.join(found, ROW, "left").select(*df.columns, *[
        F.coalesce(c, F.lit(-1 if c == "cluster" else 0.0)).alias(c) for c in found.columns if c != ROW])


def _clustered(rows, z, cols, key, method, k, seed, eps, min_samples, micro, n_neighbors, min_cluster_size, n) -> DataFrame:
    """``(ROW, cluster)`` of the rows that have one."""
    if method == "dbscan":
        from .neighbors import dbscan
        return dbscan(z, ROW, cols, eps, min_samples).select(ROW, "cluster")
    if method == "hdbscan":
        from .hdbscan import hdbscan
        return hdbscan(z, ROW, cols, min_cluster_size).select(ROW, "cluster", "probability")
    if method in ("kmeans", "bisecting"):
        est = (KMeans if method == "kmeans" else BisectingKMeans)(
            k=k, seed=seed, featuresCol=VEC, predictionCol="cluster")
        m = est.fit(_vec(z, cols))
        return m.transform(_vec(z, cols)).select(ROW, F.col("cluster").cast("int"))
    if method in ("hierarchical", "ward"):
        m_k = int(min(micro, n))
        km = KMeans(k=m_k, seed=seed, featuresCol=VEC, predictionCol="_micro").fit(_vec(z, cols))
        assigned = km.transform(_vec(z, cols)).select(ROW, "_micro")
        sizes = {r["_micro"]: r["count"] for r in assigned.groupBy("_micro").count().collect()}
        centers = np.array(km.clusterCenters())
        ids = sorted(sizes)
        groups = _ward(centers[ids], np.array([sizes[i] for i in ids]), min(k, len(ids)))
        mp = rows.sparkSession.createDataFrame([(int(i), int(g)) for i, g in zip(ids, groups)],
                                               "_micro int, cluster int")
        return assigned.join(F.broadcast(mp), "_micro").select(ROW, "cluster")
    if method == "spectral":
        from .neighbors import knn_pairs
        nn = knn_pairs(z, z, ROW, cols, n_neighbors)
        gamma = 1.0
        # each pair once, whichever of the two names the other
        edges = nn.select(F.least("q", "p").alias("src"), F.greatest("q", "p").alias("dst"),
                          F.exp(-gamma * F.col("d2")).alias("weight")) \
            .groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        pic = PowerIterationClustering(k=k, maxIter=30, weightCol="weight", initMode="degree")
        return pic.assignClusters(edges).select(F.col("id").alias(ROW), F.col("cluster").cast("int"))
    raise ValueError(f"unknown clustering method {method}")


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per cluster (noise = −1 reported separately by its label)."""
    return df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_summary(df: DataFrame, label: str = "cluster") -> dict:
    rows = cluster_sizes(df, label).collect()
    sizes = [r["size"] for r in rows if str(r["cluster"]) != "-1"]
    noise = sum(r["size"] for r in rows if str(r["cluster"]) == "-1")
    out = {"n_clusters": len(sizes), "n_noise": noise,
           "mean_size": float(np.mean(sizes)) if sizes else 0.0,
           "std_size": float(np.std(sizes)) if sizes else 0.0}
    if len(sizes) <= 1 or sum(sizes) <= 2:
        out["error"] = "need at least two clusters and three points"
    return out


def _cluster_stats(df: DataFrame, cols: Sequence[str], label: str):
    d = df.where(F.col(label).cast("string") != F.lit("-1"))
    x = [F.col(c).cast("double") for c in cols]
    g = d.groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        F.sum(sum(v * v for v in x)).alias("q")).collect()
    return d, g


def calinski_harabasz(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> float:
    _, g = _cluster_stats(df, cols, label)
    k, n = len(g), sum(r["n"] for r in g)
    d = len(cols)
    tot = np.array([sum(r[f"s{i}"] for r in g) for i in range(d)]) / n
    between = sum(r["n"] * float(np.sum((np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                                          - tot) ** 2)) for r in g)
    within = sum(r["q"] - float(np.sum(np.array([r[f"s{i}"] for i in range(d)]) ** 2)) / r["n"]
                 for r in g)
    if k < 2 or within == 0:
        return 1.0 if within == 0 else float("nan")
    return between * (n - k) / (within * (k - 1))


def davies_bouldin(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> float:
    d, g = _cluster_stats(df, cols, label)
    dim = len(cols)
    cen = {r["c"]: np.array([r[f"s{i}"] for i in range(dim)]) / r["n"] for r in g}
    spark = df.sparkSession
    ct = spark.createDataFrame([(c, [float(v) for v in cen[c]]) for c in cen],
                               f"{label} {df.schema[label].dataType.simpleString()}, _cen array<double>")
    dist = F.sqrt(sum((F.col(c).cast("double") - F.col("_cen")[i]) ** 2
                      for i, c in enumerate(cols)))
    s = {r[label]: r["s"] for r in d.join(F.broadcast(ct), label)
         .groupBy(label).agg(F.avg(dist).alias("s")).collect()}
    keys = sorted(cen)
    if len(keys) < 2:
        return 0.0
    total = 0.0
    for a in keys:
        worst = 0.0
        for b in keys:
            if a == b:
                continue
            sep = float(np.sqrt(np.sum((cen[a] - cen[b]) ** 2)))
            worst = max(worst, (s[a] + s[b]) / sep if sep > 0 else float("inf"))
        total += worst
    return total / len(keys)


def silhouette_sq(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean dissimilarity, noise excluded.

    Average squared distance from x to cluster C is ‖x‖² − 2x·μ_C + Q_C/n_C
    (Q_C = Σ‖y‖²), so every point's a(i) and b(i) come from k per-cluster sums
    broadcast to the rows; a(i) excludes the point itself."""
    d, g = _cluster_stats(df, cols, label)
    dim = len(cols)
    if len(g) < 2:
        return 0.0
    x = [F.col(c).cast("double") for c in cols]
    xx = sum(v * v for v in x)
    parts = []
    for r in g:
        s = [r[f"s{i}"] for i in range(dim)]
        dot = sum(v * F.lit(float(si)) for v, si in zip(x, s))
        total = xx * r["n"] - 2 * dot + F.lit(float(r["q"]))   # Σ_y ‖x − y‖² over the cluster
        parts.append((r["c"], r["n"], total))
    own = None
    other = None
    for c, n_c, total in parts:
        is_own = F.col(label) == F.lit(c)
        a_term = F.when(is_own, total / F.lit(max(n_c - 1, 1)))
        b_term = F.when(~is_own, total / F.lit(n_c))
        own = a_term if own is None else F.coalesce(own, a_term)
        other = b_term if other is None else F.least(other, b_term)
    sizes = {c: n_c for c, n_c, _ in parts}
    singleton = F.col(label).isin([c for c, n_c in sizes.items() if n_c == 1] or [None])
    sil = F.when(singleton, 0.0).otherwise(
        F.coalesce(F.try_divide(other - own, F.greatest(other, own)), F.lit(0.0)))
    return d.agg(F.avg(sil)).first()[0]


def cluster_metrics(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    rows = [("silhouette_sq", silhouette_sq(df, cols, label)),
            ("calinski_harabasz", calinski_harabasz(df, cols, label)),
            ("davies_bouldin", davies_bouldin(df, cols, label))]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def optimal_k(df: DataFrame, cols: Sequence[str], max_k: int = 10, seed: int = 42) -> DataFrame:
    """k = 2 … min(max_k, n−1): inertia and silhouette (squared Euclidean, Spark
    evaluator); fits run concurrently on cached standardised vectors.  Picks:
    best silhouette, the elbow rule as written in the reference
    (argmax of successive inertia differences + 2), and the knee (largest
    distance to the chord of the inertia curve)."""
    cols = list(cols)
    n = df.count()
    z = _vec(standardized(df, cols), cols).select(VEC).cache()
    ks = list(range(2, max(2, min(max_k, n - 1)) + 1))
    ev = ClusteringEvaluator(featuresCol=VEC, predictionCol="_p")

    def run(k):
        m = KMeans(k=k, seed=seed, featuresCol=VEC, predictionCol="_p").fit(z)
        return k, float(m.summary.trainingCost), float(ev.evaluate(m.transform(z)))

    with ThreadPoolExecutor(max_workers=4) as ex:
        res = sorted(ex.map(run, ks))
    z.unpersist()
    inertia = [r[1] for r in res]
    diffs = np.diff(inertia)
    elbow = int(np.argmax(diffs)) + 2 if len(diffs) else ks[0]
    x0, y0, x1, y1 = ks[0], inertia[0], ks[-1], inertia[-1]
    dist = [abs((y1 - y0) * k - (x1 - x0) * i + x1 * y0 - y1 * x0) /
            max(math.hypot(y1 - y0, x1 - x0), 1e-12) for k, i in zip(ks, inertia)]
    knee = ks[int(np.argmax(dist))]
    best_sil = max(res, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame(
        [(k, i, s, k == best_sil, k == elbow, k == knee) for k, i, s in res],
        "k int, inertia double, silhouette double, best_silhouette boolean, "
        "optimal_k_elbow boolean, optimal_k_knee boolean")


def pca(df: DataFrame, cols: Sequence[str], key: str, n_components: int = 2):
    """Scores on standardised columns (component sign fixed so the largest
    absolute loading is positive) and explained-variance ratios."""
    cols = list(cols)
    z = _vec(standardized(df, cols, keep=[key]), cols)
    m = PCA(k=n_components, inputCol=VEC, outputCol="_pc").fit(z)
    P = m.pc.toArray()
    signs = [1.0 if P[np.argmax(np.abs(P[:, j])), j] >= 0 else -1.0 for j in range(n_components)]
    arr = vector_to_array("_pc")
    scores = m.transform(z).select(key, *[(arr[j] * F.lit(signs[j])).alias(f"pc{j + 1}")
                             for j in range(n_components)])
    ratios = [float(v) for v in m.explainedVariance.toArray()]
    return scores, ratios
