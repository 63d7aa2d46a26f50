"""Outliers and anomalies.

* ``outliers`` (iqr / zscore): one quantile pass + one conditional-sum pass.
* ``isolation_forest``: per-tree samples of ≤ 256 rows chosen by seeded
  hashes (candidates filtered by hash first, so no tree's sample scales with
  the table), trees grown in ``applyInPandas`` (one group per tree), then a
  ``mapInPandas`` scoring pass in which a batch of rows walks down all trees at
  once.  Threshold = exact score quantile at the contamination rate.
* ``grouped_forest``: univariate forests for many groups in one pass; the series
  anomalies and the outliers of many columns use it.
* ``one_class_svm``: random Fourier features (Rahimi & Recht 2007) and a
  primal ν-one-class objective minimised by full-batch subgradient steps, each
  step one aggregate over the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerce_numeric, numeric_cols
from ..plans.joins import MAX_BROADCAST_BYTES
from ..plans.lineage import cut
from ..plans.ordering import GROUP_N, RANK, quantile_table, ranked
from .scale import fit_scale


def outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5,
             cols: Sequence[str] | None = None, key: str | None = None,
             max_ids: int = 100) -> DataFrame:
    """Per column: outlier count, percent of non-null values, and (with ``key``)
    the first ``max_ids`` outlier keys.  iqr: outside Q1 − t·IQR … Q3 + t·IQR
    (interpolated quartiles); zscore: |x − mean| / sample std > t."""
    cols = list(cols) if cols else numeric_cols(df, exclude=[key] if key else [])
    if method == "isolation_forest":
        # univariate forests of all columns in one pass (contamination 0.1); needs a row key
        if key is None:
            raise ValueError("the forest variant needs a key column")
        long = df.select(F.col(key).alias("_id"), F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), coerce_numeric(c).cast("double").alias("value")) for c in cols]))) \
            .where((F.abs(F.col("value")) < float("inf")) & ~F.isnan("value"))
        flagged = cut(grouped_forest(long, ["column_name"], "_id", "value", contamination=0.1))
        counts = flagged.groupBy("column_name").agg(F.count_if("is_anomaly").alias("outlier_count"),
                                                    (F.count_if("is_anomaly") / F.count(F.lit(1)) * 100.0).alias("outlier_pct"))
        first = Window.partitionBy("column_name").orderBy("_id")
        ids = flagged.where("is_anomaly").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_ids) \
            .groupBy("column_name").agg(F.sort_array(F.collect_list("_id")).alias("outlier_ids"))
        every = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
        return every.join(counts, "column_name", "left").join(ids, "column_name", "left").select(
            "column_name", F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
            F.coalesce("outlier_pct", F.lit(0.0)).alias("outlier_pct"), "outlier_ids")
    conds = {}
    if method == "iqr":
        qt = quantile_table(df, cols, [0.25, 0.75], "linear")
        for c in cols:
            q1, q3 = qt[c].get(0.25), qt[c].get(0.75)
            if q1 is None:
                conds[c] = F.lit(False)
                continue
            iqr = q3 - q1
            x = F.col(c).cast("double")
            conds[c] = (x < q1 - threshold * iqr) | (x > q3 + threshold * iqr)
    elif method == "zscore":
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                     *[F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
        for c in cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            x = F.col(c).cast("double")
            conds[c] = (F.abs((x - m) / s) > threshold) if s else F.lit(False)
    else:
        raise ValueError(f"unknown outlier method {method}")
    structs = []
    for c in cols:
        cnt = F.sum(F.when(conds[c], 1).otherwise(0)).cast("long")
        nn = F.count(F.col(c))
        structs.append(F.struct(F.lit(c).alias("column_name"), cnt.alias("outlier_count"),
                                F.coalesce(F.try_divide(cnt, nn) * 100.0, F.lit(0.0)).alias("outlier_pct")))
    out = df.agg(F.array(*structs).alias("_a")).select(F.inline("_a"))
    if key is None:
        return out
    ids = []
    for c in cols:
        ids.append(df.where(conds[c]).select(F.lit(c).alias("column_name"), F.col(key))
                   .orderBy(key).limit(max_ids))
    allids = ids[0]
    for x in ids[1:]:
        allids = allids.unionByName(x)
    lists = allids.groupBy("column_name").agg(F.sort_array(F.collect_list(key)).alias("outlier_ids"))
    return out.join(F.broadcast(lists), "column_name", "left")


def _c(n: int) -> float:
    """Average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Isolation tree as flat arrays: feature and threshold of each node, its two children
    (a leaf's are itself) and the path length that ends in it."""
    feat, thr, kids, length = [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(0)
        thr.append(0.0)
        kids.extend((i, i))
        length.append(depth + _c(len(idx)))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        kids[2 * i] = node(idx[sub[:, f] < t], depth + 1)
        kids[2 * i + 1] = node(idx[sub[:, f] >= t], depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return feat, thr, kids, length


class Forest:
    """Trees one after the other in flat arrays; rows walk down all of them at once."""

    def __init__(self, feat, thr, kids, length, start):
        self.feat, self.kids, self.start = (np.asarray(a, np.int64) for a in (feat, kids, start))
        self.thr, self.length = np.asarray(thr, float), np.asarray(length, float)

    @classmethod
    def of(cls, trees) -> "Forest":
        at = np.cumsum([0] + [len(t[0]) for t in trees])[:-1]
        return cls(*[np.concatenate([np.asarray(t[k]) + (o if k == 2 else 0) for t, o in zip(trees, at)]) for k in range(4)], at)

    def mean_length(self, X: np.ndarray, depth: int, step: int = 4096) -> np.ndarray:
        """Mean path length of each row; ``depth``: of the deepest tree."""
        out = np.empty(len(X))
        for lo in range(0, len(X), step):
            x = X[lo:lo + step]
            rows = np.arange(len(x))[:, None]
            at = np.repeat(self.start[None, :], len(x), 0)
            for _ in range(depth):
                at = self.kids[2 * at + (x[rows, self.feat[at]] >= self.thr[at])]
            out[lo:lo + step] = self.length[at].mean(1)
        return out

    def steps(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees of one feature: all thresholds in order, and the mean path lengths below the first
        and from each on.  Between two thresholds no tree tells values apart."""
        inner = self.kids[::2] != np.arange(len(self.thr))
        cuts = np.unique(self.thr[inner])
        return cuts, self.mean_length(np.concatenate([[-np.inf], cuts])[:, None], depth)


def isolation_forest(df: DataFrame, cols: Sequence[str], key: str, n_trees: int = 100,
                     sample_size: int = 256, contamination: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Adds ``anomaly_score`` (0..1, higher = more anomalous) and ``is_anomaly``."""
    cols = list(cols)
    spec = fit_scale(df, cols, "standard")
    fcols = [f"_f{i}" for i in range(len(cols))]
    fx = [coerce_numeric(spec.expr(c)).alias(f) for c, f in zip(cols, fcols)]
    feats = df.select(key, *fx)
    n = df.count()
    psi = int(min(sample_size, n))
    # candidates: one seeded hash keeps ~3ψ rows per tree in total and a second
    # hash assigns each kept row its tree, so the per-tree sample is O(ψ) and
    # each row costs two hashes — rows are replicated only when the table is
    # smaller than trees × 3ψ (then every row lands in several trees)
    want = n_trees * 3.0 * psi
    copies = max(1, int(math.ceil(want / max(n, 1))))
    frac = min(1.0, want / max(n, 1) / copies)
    cand = feats
    if frac < 1.0:
        cand = cand.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2 ** 31))
                          < F.lit(int(frac * 2 ** 31)))
    if copies > 1:
        cand = cand.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy"))
    else:
        cand = cand.withColumn("_copy", F.lit(1))
    cand = cand.withColumn("_tree", F.pmod(F.xxhash64(F.col(key), F.col("_copy"),
                                                      F.lit(seed + 1)), F.lit(n_trees)).cast("int"))
    cand = cand.dropDuplicates(["_tree", key]).withColumn(
        "_h", F.pmod(F.xxhash64(F.col(key), F.col("_tree"), F.lit(seed + 2)), F.lit(2 ** 31)))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    tree_schema = "_tree int, feat array<int>, thr array<double>, kids array<int>, length array<double>"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", key]).head(psi)
        t = int(pdf["_tree"].iloc[0])
        X = pdf[fcols].to_numpy(dtype=float)
        rng = np.random.default_rng(seed * 100003 + t)
        return pd.DataFrame([dict(zip(("_tree", "feat", "thr", "kids", "length"), (t, *_grow_tree(X, rng, max_depth))))])

    forest = cand.groupBy("_tree").applyInPandas(grow, tree_schema).collect()
    model = Forest.of([r[1:] for r in sorted(forest)]) if forest else None
    cn = _c(psi)
    bc = df.sparkSession.sparkContext.broadcast(model)  # at most trees x 2 x sample nodes

    def score(it):
        for pdf in it:
            X = pdf[fcols].to_numpy(dtype=float)
            h = bc.value.mean_length(X, max_depth)
            out = pdf.drop(columns=fcols)
            out["anomaly_score"] = 2.0 ** (-h / cn)
            yield out

    # rows pass straight through the scorer: no join back on the key
    out_schema = T.StructType(df.schema.fields + [T.StructField("anomaly_score", T.DoubleType())])
    # scored once: the quantile's passes and the output read the checkpoint
    scored = cut(df.select("*", *fx).mapInPandas(score, out_schema))
    thr = quantile_table(scored, ["anomaly_score"], [1 - contamination], "linear")
    t = thr["anomaly_score"].get(round(1 - contamination, 12))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(t))


#: Rows of a series that its trees draw their samples from; rows of one copy of its trees.
CANDIDATES, ROWS_A_COPY = 1000, 1_000_000


def grouped_forest(rows: DataFrame, by: Sequence[str], id_col: str, value: str, n_trees: int = 100, sample_size: int = 256,
                   contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """A univariate forest for every group, all in one pass: ``rows`` with ``score`` (the higher
    the more ordinary; below 0 for the ``contamination`` share) and ``is_anomaly``.

    A group's trees draw their samples from at most ``CANDIDATES`` of its rows, chosen by
    hash.  Trees and rows meet sorted by group, trees first; a group of many rows has
    several copies of its trees, and its rows are dealt over them.  One value decides a row's
    place, so many rows are looked up among the thresholds of all trees.  The limit is the
    exact quantile of each group's scores, from the count of each different one.  ``id_col`` is unique within a group; groups are not
    null, values neither null nor NaN or infinite."""
    by = list(by)
    if "_forest" in by:
        raise ValueError("_forest is taken")
    own = cut(rows)
    pick = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)
    few = own.select(*by, F.col(value).cast("double").alias("_v"), F.row_number().over(pick).alias("_n")).where(F.col("_n") <= CANDIDATES)

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        x = t.column("_v").to_numpy()[:, None]
        psi = min(sample_size, len(x))
        depth = int(math.ceil(math.log2(max(psi, 2))))
        trees = []
        for k in range(n_trees):
            rng = np.random.default_rng([seed, k])
            trees.append(_grow_tree(x[rng.choice(len(x), psi, replace=False)], rng, depth))
        f = Forest.of(trees)
        columns = {"thr": (f.thr, pa.float64()), "kids": (f.kids, pa.int64()), "length": (f.length, pa.float64()), "start": (f.start, pa.int64())}
        return pa.table({**{c: t.column(c)[:1] for c in by}, "psi": pa.array([psi], pa.int32()),
                         **{c: pa.array([a], pa.list_(k)) for c, (a, k) in columns.items()}})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    # rows without trees have empty arrays: Arrow batches take long to size with null ones
    trees = cut(few.groupBy(*by).applyInArrow(
        lambda t: grow(t), f"{kinds}, psi int, thr array<double>, kids array<long>, length array<double>, start array<long>")
        .withColumn("_forest", F.monotonically_increasing_id()))
    sizes = own.groupBy(*by).agg((F.floor((F.count(F.lit(1)) - 1) / ROWS_A_COPY) + 1).cast("int").alias("_copies"))
    known = trees.select(*by, "_forest").join(sizes, by)
    small = known.agg(F.sum(F.length(F.to_json(F.struct(*by))) + 16)).first()[0] or 0
    known = F.broadcast(known) if small <= MAX_BROADCAST_BYTES else known
    asks = own.join(known, by).select(*own.columns, "_forest", F.pmod(
        F.xxhash64(id_col), F.col("_copies")).cast("int").alias("_copy"))
    models = trees.join(known.select("_forest", "_copies"), "_forest") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop(*by, "_copies")
    both = models.withColumn("_kind", F.lit(0)).unionByName(asks.withColumn("_kind", F.lit(1)).select("*", *[
        F.array().cast(trees.schema[c].dataType).alias(c) for c in ("thr", "kids", "length", "start")]), allowMissingColumns=True)
    dealt = both.repartition("_forest", "_copy").sortWithinPartitions("_forest", "_copy", "_kind")
    names = own.columns

    def run(batches):
        at, forest, psi, steps, seen = None, None, 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            number, copy, kind = (b.column(c).to_numpy() for c in ("_forest", "_copy", "_kind"))
            turn = (np.diff(number) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)
            edges = [0, *(np.flatnonzero(turn) + 1), len(kind)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if kind[lo] == 0:
                    at, psi = (number[lo], copy[lo]), b.column("psi")[lo].as_py()
                    arrays = [b.column(c)[lo].values.to_numpy(zero_copy_only=False) for c in ("thr", "kids", "length", "start")]
                    forest, steps, seen = Forest(np.zeros(len(arrays[0])), *arrays), None, 0
                elif at == (number[lo], copy[lo]):
                    part = b.slice(lo, hi - lo).select(names)
                    x = part.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    depth = int(math.ceil(math.log2(max(psi, 2))))
                    seen += len(x)
                    # few rows walk down the trees; for many, each place between thresholds does so once
                    if steps is None and seen > len(forest.thr) // 2:
                        steps = forest.steps(depth)
                    h = forest.mean_length(x[:, None], depth) if steps is None else steps[1][np.searchsorted(steps[0], x, "right")]
                    score = 2.0 ** (-h / _c(psi)) if psi > 1 else np.full(len(x), 0.5)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    scored = cut(dealt.mapInArrow(run, f"{kinds}, _score double"))
    # a group has at most as many different scores as its trees have thresholds, and one more
    counted = scored.groupBy(*by, "_score").agg(F.count(F.lit(1)).alias("_m"))
    up = Window.partitionBy(*by).orderBy("_score").rowsBetween(Window.unboundedPreceding, 0)
    spot = (F.sum("_m").over(Window.partitionBy(*by)) - 1) * (1.0 - contamination)
    counted = counted.select(*by, "_score", "_m", F.sum("_m").over(up).alias("_last"), spot.alias("_s"))
    holds = lambda r: (F.col("_last") >= r) & (F.col("_last") - F.col("_m") < r)
    ends = counted.where(holds(F.floor("_s") + 1) | holds(F.ceil("_s") + 1)).groupBy(*by).agg(
        (F.min("_score") + (F.max("_score") - F.min("_score")) * (F.max("_s") - F.floor(F.max("_s")))).alias("_limit"))
    ends = F.broadcast(ends) if small <= MAX_BROADCAST_BYTES else ends
    return scored.join(ends, by).select(
        *names, (F.col("_limit") - F.col("_score")).alias("score"), (F.col("_score") > F.col("_limit")).alias("is_anomaly"))


def series_anomalies(df: DataFrame, value: str, order: str, by: Sequence[str] = (), contamination: float = 0.05,
                     min_points: int = 10, n_trees: int = 100, seed: int = 42) -> DataFrame:
    """``by..., index, order, value, score, is_anomaly, status`` for every present value of
    every series; ``index`` counts them from 0 in ``order``.  A series of fewer than
    ``min_points`` values has one row, with status ``too_short``.  Equal places in the order
    are put in the order of their values."""
    by = list(by)
    x = coerce_numeric(value).cast("double")
    # a series is known by a text that null parts have too
    series = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = df.select(*by, series.alias("_series"), F.col(order), x.alias("value")) \
        .where((F.abs(F.col("value")) < float("inf")) & ~F.isnan("value"))
    placed = cut(ranked(rows, [order, "value"], by=["_series"]).withColumn("index", F.col(RANK) - 1).drop(RANK))
    long = placed.where(F.col(GROUP_N) >= min_points).drop(GROUP_N)
    found = grouped_forest(long, ["_series"], "index", "value", n_trees, contamination=contamination, seed=seed)
    ok = found.select(*by, "index", order, "value", "score", "is_anomaly", F.lit("ok").alias("status"))
    # every series of the table, also one without any value
    counted = df.select(*by, F.when((F.abs(x) < float("inf")) & ~F.isnan(x), 1).alias("one"))
    counted = counted.groupBy(*by).agg(F.count("one").alias("n")) if by else counted.agg(F.count("one").alias("n"))
    short = counted.where(F.col("n") < min_points)
    blank = lambda c: F.lit(None).cast(ok.schema[c].dataType).alias(c)
    return ok.unionByName(short.select(*by, *[blank(c) for c in ("index", order, "value", "score", "is_anomaly")],
                                       F.lit("too_short").alias("status")))


def one_class_svm(df: DataFrame, cols: Sequence[str], key: str, nu: float = 0.1,
                  gamma: float | None = None, n_features: int = 64, iters: int = 30,
                  seed: int = 42) -> DataFrame:
    """Adds ``decision`` (w·z(x) − ρ) and ``is_anomaly`` (decision < 0).

    z(x) are random Fourier features of the standardised columns.  Each
    subgradient step is one ``mapInPandas`` pass over the cached features that
    returns per-batch sums (violations and Σz over violators) — bounded output
    — merged by one aggregate."""
    cols = list(cols)
    d = len(cols)
    spec = fit_scale(df, cols, "standard")
    g = gamma if gamma is not None else 1.0 / max(d, 1)
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * g), size=(n_features, d))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    fcols = [f"_f{i}" for i in range(d)]
    X = df.select(*[coerce_numeric(spec.expr(c)).alias(f) for c, f in zip(cols, fcols)]).cache()
    n = X.count()
    stat_schema = "m long, " + ", ".join(f"s{k} double" for k in range(n_features))

    def stats_for(w, rho):
        def part(it):
            for pdf in it:
                Z = np.cos(pdf[fcols].to_numpy(dtype=float) @ W.T + b) * scale
                v = (Z @ w) < rho
                row = {"m": [int(v.sum())]}
                sums = Z[v].sum(axis=0) if v.any() else np.zeros(n_features)
                row.update({f"s{k}": [float(sums[k])] for k in range(n_features)})
                yield pd.DataFrame(row)
        agg = X.mapInPandas(part, stat_schema).agg(
            F.sum("m").alias("m"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(n_features)]
        ).first()
        return agg["m"] or 0, np.array([agg[f"s{k}"] or 0.0 for k in range(n_features)])

    # start from the mean feature vector (the ν → 1 solution direction)
    _, total = stats_for(np.zeros(n_features), 1.0)
    w = total / max(n, 1)
    rho = 0.0
    for it in range(iters):
        lr = 1.0 / (1 + it)
        m, sz = stats_for(w, rho)
        step = w - sz / max(nu * n, 1.0)
        w = w - lr * step
        rho = rho - lr * (-1.0 + m / max(nu * n, 1.0))
        if lr * np.linalg.norm(step) < 1e-3 * max(np.linalg.norm(w), 1e-12):
            break
    X.unpersist()
    w_f = w.copy()

    def decide(it):
        for pdf in it:
            Z = np.cos(pdf[fcols].to_numpy(dtype=float) @ W.T + b) * scale
            out = pdf.drop(columns=fcols)
            out["decision"] = Z @ w_f
            yield out

    out_schema = T.StructType(df.schema.fields + [T.StructField("decision", T.DoubleType())])
    fx = [coerce_numeric(spec.expr(c)).alias(f) for c, f in zip(cols, fcols)]
    scored = cut(df.select("*", *fx).mapInPandas(decide, out_schema))
    # ρ is the ν-quantile of w·z: that share of the rows lies beyond the boundary,
    # however far the descent has come
    rho = quantile_table(scored, ["decision"], [nu], "linear")["decision"].get(round(nu, 12))
    return scored.withColumn("decision", F.col("decision") - F.lit(rho)) \
        .withColumn("is_anomaly", F.col("decision") < 0)
