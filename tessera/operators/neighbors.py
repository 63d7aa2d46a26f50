"""Operators built on exact neighbour search.

``knn_pairs`` finds the k nearest points of every query in blocks around pivots
(:mod:`..plans.pivots`): a first search bounds each query's k-th distance, a second
one visits the blocks within it.

KNN prediction, SMOTE, ADASYN and DBSCAN use these joins; DBSCAN's clusters
are connected components found by label propagation over core edges, with a
reliable checkpoint every few rounds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric
from ..plans.joins import join_small
from ..plans.lineage import cut
from ..plans.ordering import RANK, ranked
from ..plans.pivots import nearest

GRID_DIMS = 3
IN_ORDER = 4096         # values of one coordinate in a window
COPY_CHUNK = 1_000_000   # synthetic rows that one row makes in one task


def _sqdist(a: str, b: str, feats: Sequence[str]):
    # products, not pow(): bit-identical to any SQL engine's (a - b) * (a - b)
    out = None
    for f in feats:
        diff = F.col(f"{a}.{f}") - F.col(f"{b}.{f}")
        out = diff * diff if out is None else out + diff * diff
    return out


def knn_pairs(queries: DataFrame, points: DataFrame, key: str, feats: Sequence[str], k: int,
              by: Sequence[str] = (), include_self: bool = False) -> DataFrame:
    """Exact k nearest points of every query → ``(by..., q, p, d2, nn_rank)``
    (ties by point key), by the blocks of :mod:`..plans.pivots`, or on one coordinate in its
    order.  Queries with fewer than
    k points in their group get all of them.  Rows with a null, NaN or infinite coordinate,
    or a null group, are no points and have no neighbours."""
    if len(feats) == 1:
        return _nearest_in_order(queries, points, key, feats[0], k, by, include_self)
    return nearest(queries, points, key, feats, k, by, include_self)[0]


def _nearest_in_order(queries: DataFrame, points: DataFrame, key: str, feature: str, k: int, by: Sequence[str],
                      include_self: bool) -> DataFrame:
    """``knn_pairs`` on one coordinate: the nearest of a value are among the values next to it in
    order, in windows of at most ``IN_ORDER`` of them and the edges of the next.  Queries of a
    value share a list, of one more than ``k``, as each leaves itself out.  Queries between the
    points' values, and those whose last neighbours may tie by rounding with points beyond
    the window, are searched for in blocks around pivots."""
    by, want = list(by), k if include_self else k + 1
    side = want + 1
    block = max(IN_ORDER, side)
    x = (F.col(feature).cast("double") + F.lit(0.0)).alias("x")     # -0.0 is 0.0
    fine = lambda d, c: d.where((F.abs("x") < float("inf")) & ~F.isnan("x")).dropna(subset=[*by, *c])
    ask = fine(queries.select(*by, F.col(key).alias("q"), x), ["q"])
    # a row without a key is no other than the query
    pts = fine(points.select(*by, F.col(key).alias("p"), x), [] if include_self else ["p"])
    few = pts.withColumn("_c", F.row_number().over(Window.partitionBy(*by, "x").orderBy("p"))).where(F.col("_c") <= want)
    values = cut(few.groupBy(*by, "x").agg(F.collect_list("p").alias("ps")))
    spot = F.col(RANK) - 1
    at = lambda r: F.floor(r / block)
    placed = ranked(values, ["x"], by=by, with_group_size=False).select(*by, "x", "ps", at(spot).alias("_own"), F.explode(
        F.array_distinct(F.array(at(spot), at(spot - side), at(spot + side)))).alias("_in"))
    w = Window.partitionBy(*by, "_in").orderBy("x").rowsBetween(-side, side)
    near = placed.withColumn("near", F.collect_list(F.struct("x", "ps")).over(w)).where(F.col("_own") == F.col("_in"))
    gap = lambda t: (F.col("x") - t["x"]) * (F.col("x") - t["x"])
    first = F.slice(F.array_sort(F.flatten(F.transform("near", lambda t: F.transform(
        t["ps"], lambda p: F.struct(gap(t).alias("d2"), p.alias("p")))))), 1, want)
    last = F.get("first", F.lit(want - 1))["d2"]
    beyond = lambda ts, end: (F.size(ts) >= side) & (gap(end(ts)) <= last)
    unsure = beyond(F.filter("near", lambda t: t["x"] < F.col("x")), lambda ts: F.get(ts, F.lit(0))) | \
        beyond(F.filter("near", lambda t: t["x"] > F.col("x")), lambda ts: F.try_element_at(ts, F.lit(-1)))
    lists = cut(near.withColumn("first", first).select(*by, "x", "first", F.coalesce(unsure, F.lit(False)).alias("_unsure")))
    # rows that repeat a key are met as often as the join by key did
    mine = Window.partitionBy(*by, "q")
    asked = cut(join_small(ask.withColumn("_m", F.count(F.lit(1)).over(mine)), lists, [*by, "x"], "left"))
    sure = ~F.coalesce("_unsure", F.lit(True))
    other = F.col("first") if include_self else F.filter("first", lambda e: e["p"] != F.col("q"))
    found = asked.where(sure).select(*by, "q", F.inline(F.flatten(F.array_repeat(other, F.col("_m").cast("int"))))) \
        .select(*by, "q", "p", "d2")
    rest = asked.where(~sure)
    if not rest.isEmpty():
        far = nearest(rest.select(*by, F.col("q").alias(key), F.col("x").alias(feature)), points, key, [feature], k, by, include_self)[0]
        found = found.unionByName(far.select(*by, "q", "p", "d2"))
    return cut(found.withColumn("nn_rank", F.row_number().over(mine.orderBy("d2", "p"))).where(F.col("nn_rank") <= k))


class KNNModel:
    """k-nearest-neighbour classifier / regressor as a Spark join at predict time."""

    def __init__(self, features, k=5, weights="uniform", problem="classification", n_classes=0):
        self.features, self.k, self.weights, self.problem = list(features), k, weights, problem
        self.n_classes, self.train = n_classes, None

    def fit(self, df: DataFrame):
        feats = [coerce_numeric(c).alias(f"_x_{i}") for i, c in enumerate(self.features)]
        # numbered once and written: a lost executor reads the same numbers again
        self.train = cut(df.select(F.monotonically_increasing_id().alias("_pk"), *feats, F.col("_label")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fx = [f"_x_{i}" for i in range(len(self.features))]
        q = df.withColumn("_qk", F.monotonically_increasing_id())
        q = cut(q)
        qf = q.select(F.col("_qk"), *[coerce_numeric(c).alias(f) for c, f in
                                      zip(self.features, fx)])
        pf = self.train.select(F.col("_pk").alias("_qk"), *fx)
        nn = knn_pairs(qf, pf, "_qk", fx, self.k, include_self=True)
        lab = self.train.select(F.col("_pk").alias("p"), F.col("_label").alias("_y"))
        nn = nn.join(lab, "p")
        wt = 1.0 / F.greatest(F.sqrt("d2"), F.lit(1e-12)) if self.weights == "distance" \
            else F.lit(1.0)
        nn = nn.withColumn("_w", wt)
        if self.problem.lower().startswith("class"):
            votes = nn.groupBy("q", "_y").agg(F.sum("_w").alias("_s"))
            pred = votes.groupBy("q").agg(
                F.min_by("_y", F.struct(-F.col("_s"), F.col("_y"))).alias("prediction"), F.sum("_s").alias("_all"),
                F.map_from_entries(F.collect_list(F.struct(F.col("_y").cast("int"), "_s"))).alias("_votes"))
            share = F.transform(F.sequence(F.lit(0), F.lit(max(self.n_classes, 1) - 1)),
                                lambda c: F.coalesce(F.col("_votes")[c], F.lit(0.0)) / F.col("_all"))
            pred = pred.select("q", "prediction", *([share.alias("probability")] if self.n_classes else []))
        else:
            pred = nn.groupBy("q").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w"))
                                       .alias("prediction"))
        return q.join(pred.withColumnRenamed("q", "_qk"), "_qk", "left").drop("_qk")


def _between(own: DataFrame, nn: DataFrame, base: DataFrame, key: str, label: str, fx, seed: int,
             most: int) -> DataFrame:
    """``_copies`` points between each row of ``own`` and its neighbours, chosen by seeded
    hashes of the key and the copy's number.  A row first gets its (at most k) neighbours
    as an array; then its copies are made in two levels, chunks and rows, so that a row
    grown to billions of copies is spread and nothing is joined on its key afterwards."""
    pts = base.select(F.col(key).alias("p"), F.struct(*fx).alias("_x"))
    near = nn.select(F.col("q").alias(key), "p", "nn_rank").join(pts, "p").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("nn_rank", "_x"))).alias("_near"))
    rows = own.join(near, key).withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPY_CHUNK))))
    if most > COPY_CHUNK:
        rows = rows.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("_chunk") * COPY_CHUNK + 1
    rows = rows.withColumn("_j", F.explode(F.sequence(first, F.least(F.col("_copies"), first + (COPY_CHUNK - 1)))))
    pick = F.get("_near", F.pmod(F.xxhash64(key, "_j", F.lit(seed + 1)), F.size("_near")).cast("int"))["_x"]
    u = F.pmod(F.xxhash64(key, "_j", F.lit(seed + 2)), F.lit(1_000_000)) / 1e6
    return rows.withColumn("_to", pick).withColumn("_u", u).select(
        key, label, *[(F.col(f) + F.col("_u") * (F.col("_to")[f] - F.col(f))).alias(f) for f in fx]) \
        .withColumn("_synthetic", F.lit(True))


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], strategy: str = "auto",
          k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows x + u·(x_nn − x), x_nn among the k nearest
    neighbours inside the class (k = min(k, n_minority − 1)); a class with
    fewer than 2 rows falls back to random oversampling.  Adds ``_synthetic``."""
    from .balance import class_counts, oversample, target_classes
    counts = class_counts(df, label)
    t = max(counts.values())
    classes = [c for c in target_classes(counts, strategy, "over") if counts[c] < t]
    if not classes:
        return df.withColumn("_synthetic", F.lit(False))
    if min(counts[c] for c in classes) < 2:
        return oversample(df, label, key, strategy, seed).withColumn(
            "_synthetic", F.col("_copy") > 0).drop("_copy")
    kk = max(1, min(k, min(counts[c] for c in classes) - 1))
    fx = [f"_x_{i}" for i in range(len(features))]
    base = df.select(F.col(key), F.col(label), *[coerce_numeric(c).alias(f)
                                                 for c, f in zip(features, fx)])
    minority = base.where(F.col(label).isin(classes))
    nn = knn_pairs(minority, minority, key, fx, kk, by=[label])
    # synthetic sample j of class c comes from row (j mod n_c) in hash order
    need = {c: t - counts[c] for c in classes}
    spark = df.sparkSession
    ltype = df.schema[label].dataType.simpleString()
    plan = spark.createDataFrame([(c, int(need[c]), int(counts[c])) for c in classes],
                                 f"{label} {ltype}, _need long, _n long")
    r = ranked(minority.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key],
               by=[label], with_group_size=False, max_groups=len(classes))
    r = r.join(F.broadcast(plan), label)
    copies = (F.col("_need") / F.col("_n")).cast("long") + \
        F.when(F.col(RANK) <= F.col("_need") % F.col("_n"), 1).otherwise(0)
    synth = _between(r.withColumn("_copies", copies).where(F.col("_copies") > 0), nn, base, key, label, fx, seed,
                     max(need.values()))
    out = base.withColumn("_synthetic", F.lit(False)).unionByName(synth)
    return out.select(key, label, *[F.col(f).alias(c) for f, c in zip(fx, features)],
                      "_synthetic")


def adasyn(df: DataFrame, label: str, key: str, features: Sequence[str], strategy: str = "auto",
           k: int = 5, seed: int = 42) -> DataFrame:
    """ADASYN: like SMOTE, but each minority row's share of the synthetic rows is
    proportional to the fraction of majority rows among its k neighbours in the
    whole table.  Fewer than 3 minority rows → random oversampling."""
    from .balance import class_counts, oversample, target_classes
    counts = class_counts(df, label)
    t = max(counts.values())
    classes = [c for c in target_classes(counts, strategy, "over") if counts[c] < t]
    if not classes or min(counts[c] for c in classes) < 3:
        return oversample(df, label, key, strategy, seed).withColumn(
            "_synthetic", F.col("_copy") > 0).drop("_copy")
    kk = max(1, min(k, min(counts[c] for c in classes) - 1))
    fx = [f"_x_{i}" for i in range(len(features))]
    base = df.select(F.col(key), F.col(label), *[coerce_numeric(c).alias(f)
                                                 for c, f in zip(features, fx)])
    minority = base.where(F.col(label).isin(classes))
    allnn = knn_pairs(minority, base, key, fx, kk)
    labs = base.select(F.col(key).alias("p"), F.col(label).alias("_pl"))
    own = minority.select(F.col(key).alias("q"), F.col(label).alias("_ql"))
    ratio = allnn.join(labs, "p").join(own, "q").groupBy("q", "_ql").agg(
        (F.sum(F.when(F.col("_pl") != F.col("_ql"), 1).otherwise(0)) / F.lit(kk)).alias("_r"))
    tot = ratio.groupBy("_ql").agg(F.sum("_r").alias("_rs"))
    need = {c: t - counts[c] for c in classes}
    spark = df.sparkSession
    ltype = df.schema[label].dataType.simpleString()
    plan = spark.createDataFrame([(c, int(need[c])) for c in classes], f"_ql {ltype}, _need long")
    g = ratio.join(F.broadcast(tot), "_ql").join(F.broadcast(plan), "_ql").withColumn(
        "_copies", F.round(F.col("_r") / F.when(F.col("_rs") > 0, F.col("_rs")).otherwise(1.0)
                           * F.col("_need")).cast("long"))
    sm_nn = knn_pairs(minority, minority, key, fx, kk, by=[label])
    own = g.where(F.col("_copies") > 0).select(F.col("q").alias(key), F.col("_ql").alias(label), "_copies") \
        .join(base.select(F.col(key), *fx), key)
    synth = _between(own, sm_nn, base, key, label, fx, seed, max(need.values()))
    out = base.withColumn("_synthetic", F.lit(False)).unionByName(synth)
    return out.select(key, label, *[F.col(f).alias(c) for f, c in zip(fx, features)],
                      "_synthetic")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(v)``, ``edges(a, b)`` (both directions present) → ``(v, comp)``
    with comp = smallest vertex id of the component.

    Each round: every vertex takes the smallest label among its neighbours;
    each old label (a tree root) takes the smallest label its members found
    (hooking); then labels jump to their label's label twice (pointer
    jumping).  Rounds grow with log(diameter), not the diameter.  Every round
    is cut with a reliable checkpoint so a lost executor replays one round."""
    least = lambda a, b: F.least(F.col(a), F.coalesce(F.col(b), F.col(a)))
    lab = cut(vertices.select(F.col("v"), F.col("v").alias("comp")))
    while True:  # labels only fall, so it ends
        prop = edges.join(lab.withColumnRenamed("v", "a"), "a") \
            .groupBy(F.col("b").alias("v")).agg(F.min("comp").alias("_m"))
        new = lab.join(prop, "v", "left").select("v", least("comp", "_m").alias("comp"))
        hook = new.join(lab.withColumnRenamed("comp", "_old"), "v") \
            .groupBy(F.col("_old").alias("v")).agg(F.min("comp").alias("_h"))
        new = new.join(hook, "v", "left").select("v", least("comp", "_h").alias("comp"))
        for _j in range(2):
            par = new.select(F.col("v").alias("comp"), F.col("comp").alias("_pc"))
            new = new.join(par, "comp", "left").select("v", least("comp", "_pc").alias("comp"))
        new = cut(new)
        changed = new.join(lab.withColumnRenamed("comp", "_old"), "v") \
            .where(F.col("comp") != F.col("_old")).limit(1).count()
        lab = new
        if changed == 0:
            return lab


def _box_gap2(a: str, b: str, side: float, wide: bool):
    """Squared least (``wide``: greatest) distance of two cells from their coordinates."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    step = (lambda x: x + 1) if wide else (lambda x: F.greatest(x - 1, F.lit(0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + step(x) * step(x) * F.lit(side * side))


#: Pairs of points that a pair of boxes may be compared by; halvings after which it is anyway.
FEW_PAIRS, HALVINGS = 4096, 40


def _touching(core: DataFrame, pairs: DataFrame, fx: Sequence[str], side: float, eps: float) -> DataFrame:
    """Of ``pairs (a, b, ca, cb)`` of cells those with a point of each within eps, ``(a, b)``.

    Both cells are halved on every axis, round by round.  Of the pairs of boxes (as tight
    as their points) one that lies within eps as a whole decides its cells, one beyond
    eps is dropped, one of few points is compared, and only the rest are halved again."""
    eps2 = eps * eps
    open_, links = pairs.select("a", "b", "ca", "cb"), None
    for level in range(1, HALVINGS + 1):
        wanted = open_.select(F.col("a").alias("cell")).unionByName(open_.select(F.col("b").alias("cell"))).distinct()
        box = F.array(*[F.floor(F.col(f) * F.lit(float(2 ** level)) / F.lit(side)).cast("long") for f in fx])
        points = cut(core.join(wanted, "cell", "left_semi").select("cell", box.alias("box"), *fx))
        boxes = points.groupBy("cell", "box").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(f) for f in fx]).alias("lo"),
                                                  F.array(*[F.max(f) for f in fx]).alias("hi")) \
            .withColumn("up", F.transform("box", lambda c: F.shiftright(c, 1)))
        of = lambda x: boxes.select(F.col("cell").alias(x), F.col("up").alias(f"c{x}"),
                                    *[F.col(c).alias(f"{c}_{x}") for c in ("box", "n", "lo", "hi")])
        sq = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
                         lambda x, y: F.greatest(x, y, F.lit(0.0)))
        far = F.zip_with(F.zip_with("hi_a", "lo_b", lambda x, y: x - y), F.zip_with("hi_b", "lo_a", lambda x, y: x - y),
                         lambda x, y: F.greatest(x, y))
        near = cut(open_.join(of("a"), ["a", "ca"]).join(of("b"), ["b", "cb"]).withColumn("gap", sq(gap)).withColumn("far", sq(far))
                   .where(F.col("gap") <= eps2 * (1 + 1e-9)))
        found = near.where(F.col("far") <= eps2 * (1 - 1e-9)).select("a", "b").distinct()
        rest = near.join(found, ["a", "b"], "left_anti")
        few = F.lit(level == HALVINGS) | (F.col("n_a") * F.col("n_b") <= FEW_PAIRS)
        small = rest.where(few).select("a", "b", "box_a", "box_b")
        side_of = lambda x: points.select(F.col("cell").alias(x), F.col("box").alias(f"box_{x}"),
                                          *[F.col(f).alias(f"{f}_{x}") for f in fx])
        met = small.join(side_of("a"), ["a", "box_a"]).join(side_of("b"), ["b", "box_b"]).where(sum(
            ((F.col(f"{f}_a") - F.col(f"{f}_b")) * (F.col(f"{f}_a") - F.col(f"{f}_b")) for f in fx[1:]),
            (F.col(f"{fx[0]}_a") - F.col(f"{fx[0]}_b")) * (F.col(f"{fx[0]}_a") - F.col(f"{fx[0]}_b"))) <= eps2)
        found = cut(found.unionByName(met.select("a", "b").distinct()).distinct())
        links = found if links is None else links.unionByName(found)
        open_ = cut(rest.where(~few).join(found, ["a", "b"], "left_anti")
                    .select("a", "b", F.col("box_a").alias("ca"), F.col("box_b").alias("cb")))
        if open_.isEmpty():
            return links
    return links


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5,
           min_samples: int = 5) -> DataFrame:
    """Adds ``cluster`` (−1 = noise).  Core: ≥ min_samples points (itself
    included) within eps.  Clusters are connected components of core points;
    a border point joins the smallest adjacent cluster; clusters are numbered
    0.. by their smallest core key.

    Points fall into cells whose diagonal is eps, so the points of a cell are all
    neighbours: a cell of ``min_samples`` points needs no counting, and components are
    found among cells.  Points are compared only between cells that touch eps without
    lying within it as a whole, and only those near enough to the other cell; whether two
    dense cells are linked is found by halving them.  No list of all pairs within eps is
    ever made.
    """
    d = len(features)
    fx = [f"_x_{i}" for i in range(d)]
    side = eps / math.sqrt(d)
    pts = df.select(F.col(key).alias("q"), *[coerce_numeric(c).alias(f) for c, f in zip(features, fx)])
    coords = F.array(*[F.floor(F.col(f) / F.lit(side)).cast("long") for f in fx])
    pts = cut(pts.withColumn("_c", coords).withColumn("cell", F.concat_ws(",", F.col("_c").cast("array<string>"))))
    cells = cut(pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.first("_c").alias("_c")))
    # cells within eps of each other, by a coarse grid of side eps over the first axes
    g = min(d, GRID_DIMS)
    coarse = [F.floor(F.get("_c", i) * F.lit(side) / F.lit(eps)).cast("long") for i in range(g)]
    reach = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product([-2, -1, 0, 1, 2], repeat=g)])
    left = cells.select(F.col("cell").alias("a"), F.col("_c").alias("ca"), F.col("n").alias("na"),
                        *[c.alias(f"_g{i}") for i, c in enumerate(coarse)]) \
        .withColumn("_off", F.explode(reach)).select(
            "a", "ca", "na", *[(F.col(f"_g{i}") + F.col("_off")[i]).alias(f"_g{i}") for i in range(g)])
    right = cells.select(F.col("cell").alias("b"), F.col("_c").alias("cb"), F.col("n").alias("nb"),
                         *[c.alias(f"_g{i}") for i, c in enumerate(coarse)])
    near = left.join(right, [f"_g{i}" for i in range(g)]).where(F.col("a") != F.col("b")) \
        .where(_box_gap2("ca", "cb", side, False) <= eps * eps * (1 + 1e-9))
    near = cut(near.select("a", "b", "ca", "cb", "na", "nb",
                           (_box_gap2("ca", "cb", side, True) <= eps * eps * (1 - 1e-9)).alias("whole")))

    def reaches(cell: str):
        """Squared distance of a point to a cell's box is within eps."""
        out = F.lit(0.0)
        for i, f in enumerate(fx):
            lo = F.get(cell, i) * F.lit(side)
            gap = F.greatest(F.lit(0.0), lo - F.col(f), F.col(f) - lo - F.lit(side))
            out = out + gap * gap
        return out <= eps * eps * (1 + 1e-9)

    def met(own: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
        """(q, p, a, b) of points within eps in the pairs of cells that are not whole."""
        part = pairs.where(~F.col("whole"))
        x = own.select("q", F.col("cell").alias("a"), *fx).join(part.select("a", "b", "cb"), "a") \
            .where(reaches("cb")).select("a", "b", "q", *fx)
        y = others.select(F.col("q").alias("p"), F.col("cell").alias("b"), *fx).join(part.select("a", "b", "ca"), "b") \
            .where(reaches("ca")).select("a", "b", "p", *fx)
        return x.alias("a").join(y.alias("b"), ["a", "b"]).where(_sqdist("a", "b", fx) <= F.lit(eps * eps)) \
            .select("q", "p", "a", "b")

    sparse_cells = cells.where(F.col("n") < min_samples)
    sparse = pts.join(sparse_cells.select("cell"), "cell", "left_semi")
    by_cell = near.where("whole").groupBy(F.col("a").alias("cell")).agg(F.sum("nb").alias("m"))
    one_by_one = met(sparse, pts, near.where(F.col("na") < min_samples)).groupBy("q").agg(F.count(F.lit(1)).alias("k"))
    counted = sparse.join(sparse_cells.select("cell", "n"), "cell").join(by_cell, "cell", "left").join(one_by_one, "q", "left")
    core_q = counted.where(F.col("n") + F.coalesce("m", F.lit(0)) + F.coalesce("k", F.lit(0)) >= min_samples).select("q")
    core = cut(pts.join(cells.where(F.col("n") >= min_samples).select("cell"), "cell", "left_semi")
               .unionByName(pts.join(core_q, "q", "left_semi")))
    core_cells = cut(core.groupBy(F.col("cell").alias("v")).agg(F.min("q").alias("least")))
    alive = near.join(core_cells.select(F.col("v").alias("a")), "a", "left_semi") \
        .join(core_cells.select(F.col("v").alias("b")), "b", "left_semi")
    edges = cut(alive.where("whole").select("a", "b").unionByName(
        _touching(core.select("cell", *fx), alive.where("a < b and not whole"), fx, side, eps)))
    comp = connected_components(core_cells.select("v"), edges.unionByName(edges.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = comp.join(core_cells, "v").groupBy("comp").agg(F.min("least").alias("least"))
    ids = ranked(named, ["least"], with_group_size=False) \
        .select("comp", (F.col(RANK) - 1).cast("int").alias("cluster"))
    of_cell = comp.join(ids, "comp").select(F.col("v").alias("cell"), "cluster")
    core_lab = core.join(of_cell, "cell").select("q", "cluster")
    # border points: in a cell with a core point, near a whole cell, or near a core point
    rest = pts.join(core.select("q"), "q", "left_anti")
    same = rest.join(of_cell, "cell").select("q", "cluster")
    whole = rest.select("q", F.col("cell").alias("a")).join(near.where("whole").select("a", F.col("b").alias("cell")), "a") \
        .join(of_cell, "cell").select("q", "cluster")
    close = met(rest, core, near).join(of_cell.withColumnRenamed("cell", "b"), "b").select("q", "cluster")
    border = same.unionByName(whole).unionByName(close).groupBy("q").agg(F.min("cluster").alias("cluster"))
    labels = core_lab.unionByName(border).withColumnRenamed("q", key)
    return df.join(labels, key, "left").withColumn(
        "cluster", F.coalesce(F.col("cluster"), F.lit(-1)))
