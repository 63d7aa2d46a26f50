"""HDBSCAN: density clusters at every scale, chosen by their stability.

1. *Core distances*: the distance to the ``min_samples``-th other point, by the exact search
   of :mod:`..plans.pivots`.  Two points are as far apart as the greatest of their distance
   and their two core distances (mutual reachability).
2. *Spanning tree* by Borůvka's rounds over components.  Each round every component takes its
   shortest link to another one.  Links of near neighbours are known; a point whose unlisted
   neighbours might offer a shorter one searches the blocks within its component's best
   link, without those that lie in its own component.
3. *Small components* (fewer than ``min_cluster_size`` points) are contracted on the tree:
   a point leaves its cluster at the height where its component first has that many points.
   Chains of small components that end at a large one hang on it at their own heights, so
   at most ``min_cluster_size`` rounds are needed, each of a few joins.
4. What is left joins large components.  In one task, in the order of height (a tree of at
   most rows / ``min_cluster_size`` vertices), each join ends the clusters it meets and
   starts their parent.
5. Points find the cluster that was alive at their height, by ancestors at distances 1, 2,
   4, ...; their sum gives each cluster its stability: the sum over its points of 1/height
   where they leave minus 1/height where the cluster starts.  A cluster is chosen when it is
   more stable than the best choice among its descendants; the whole table is never chosen.

Equal heights are one event: a cluster without extent between two heights is never chosen,
so the result depends neither on the order of rows nor on which of equal links is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric
from ..plans.joins import join_small
from ..plans.lineage import cut
from ..plans.pivots import Blocks, column_matrix, nearest, squared, usable

#: Neighbours listed beyond ``min_samples``; so many links are followed by the driver, and edges
#: contracted in one task, with the same result as by joins.
MORE, FEW = 4, 50_000


def roots(pointers: DataFrame) -> DataFrame:
    """``pointers (c, to)``, one for each ``c``, in trees that end at a root (``to`` = itself, or
    no row of its own) or at a pair that point at each other (its smaller one is the root)
    → ``(c, root)``."""
    spark = pointers.sparkSession
    rows = pointers.limit(FEW + 1).collect()
    if not rows:
        return spark.createDataFrame([], "c long, root long")
    if len(rows) <= FEW:
        c, to = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        order = np.argsort(c)
        c, to = c[order], to[order]
        at = np.searchsorted(c, to)
        known = c[np.minimum(at, len(c) - 1)] == to     # the target has a pointer of its own
        own = np.arange(len(c))
        up = np.where(known, at, own)
        up = np.where((up[up] == own) & (own < up), own, up)
        while (up[up] != up).any():
            up = up[up]
        end = np.where(known[up], c[up], to[up])
        return spark.createDataFrame(pd.DataFrame({"c": c, "root": end}), "c long, root long")
    back = pointers.select(F.col("c").alias("to"), F.col("to").alias("back"))
    p = cut(pointers.join(back, "to", "left").select(
        "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
    while True:
        further = p.select(F.col("c").alias("to"), F.col("to").alias("next"))
        p2 = cut(p.join(further, "to", "left").select("c", F.coalesce("next", "to").alias("to"),
                                                      (F.coalesce("next", "to") != F.col("to")).alias("moved")))
        p = p2.select("c", "to")
        if p2.where("moved").isEmpty():
            return p.withColumnRenamed("to", "root")


def _link_search(dims: int):
    """Each query's shortest link to a point of another mark."""
    def compare(q, p):
        x, y = column_matrix(q, "v", dims), column_matrix(p, "v", dims)
        get = lambda t, c: t.column(c).to_numpy() if isinstance(t, pa.Table) else t.column(c).to_numpy(zero_copy_only=False)
        cq, cp, mq, mp, idp = get(q, "core"), get(p, "core"), get(q, "mark"), get(p, "mark"), get(p, "id")
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        rough = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
        np.maximum(rough, (cq ** 2)[:, None], out=rough)
        np.maximum(rough, (cp ** 2)[None, :], out=rough)
        rough[mq[:, None] == mp[None, :]] = np.inf
        least = rough.min(1)
        slack = 1e-12 * (dims + 4) * (xx + yy.max())
        i, j = np.nonzero(rough <= (least + 2 * slack)[:, None])
        i, j = i[np.isfinite(least[i])], j[np.isfinite(least[i])]
        w = np.maximum.reduce([np.sqrt(squared(x[i], y[j])), cq[i], cp[j]])
        order = np.lexsort((idp[j], w, i))
        i, j, w = i[order], j[order], w[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        yield pa.RecordBatch.from_arrays([q.column("q").take(pa.array(i[first])), pa.array(idp[j[first]]), pa.array(w[first]),
                                          q.column("at").take(pa.array(i[first]))], names=["a", "b", "w", "at"])
    return compare


def spanning_tree(points: DataFrame, lists: DataFrame, dims: int) -> DataFrame:
    """Edges ``(a, b, w)`` of a least spanning tree under mutual reachability.  ``points
    (id, v, core, beyond)``: every link of a point that is not in ``lists (a, b, w)`` is
    at least ``beyond`` long."""
    blocks = Blocks(points.select("id", "v", "core"), dims)
    comp = cut(points.select("id", F.col("id").alias("comp")))
    of = lambda c, to: comp.select(F.col("id").alias(c), F.col("comp").alias(to))
    live, tree, left = lists, None, points.count()

    def best(links):
        """The shortest link of each component and the component it leads to."""
        both = links.select(F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("to")) \
            .unionByName(links.select(F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("to")))
        # the same order of links for both components
        return both.groupBy("c").agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "to"))
                                     .alias("m")).select("c", "m.w", "m.lo", "m.hi", "m.to")

    while left > 1:
        live = cut(live.select("a", "b", "w").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb"))
        known = best(live)
        waiting = cut(points.join(comp, "id").join(known.select(F.col("c").alias("comp"), "w"), "comp", "left")
                      .where(F.col("w").isNull() | (F.col("beyond") < F.col("w")))
                      .select(F.col("id").alias("q"), "v", "core", "beyond", F.col("comp").alias("mark"), F.col("w").alias("bound")))
        # components whose listed links are surely the shortest go first; others wait
        picked = cut(known.join(waiting.select(F.col("mark").alias("c")).distinct(), "c", "left_anti"))
        if picked.isEmpty():
            marked, cells, rings = blocks.marked(comp.select("id", F.col("comp").alias("mark")))
            waiting = blocks.grouped(waiting)

            def searched(queries, want=None):
                seen = cut(blocks.visits(queries, want, cells, rings))
                found = blocks.meet(seen, queries, _link_search(dims), "a long, b long, w double", marked)
                return found.join(of("a", "ca"), "a").join(of("b", "cb"), "b")
            # one point of each component, for a bound
            one = waiting.groupBy("mark").agg(F.min(F.struct("beyond", "q")).alias("m")).select(F.col("m.q").alias("q"))
            links = cut(live.unionByName(searched(waiting.join(one, "q", "left_semi").withColumn("bound", F.lit(0.0)), 1)))
            bound = best(links).select(F.col("c").alias("mark"), F.col("w").alias("bound"))
            rest = cut(waiting.drop("bound").join(bound, "mark").where(F.col("beyond") < F.col("bound")))
            picked = cut(best(links.unionByName(searched(rest))))
        new = cut(picked.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct())
        left -= new.count()
        tree = new if tree is None else tree.unionByName(new)
        comp = cut(comp.join(roots(picked.select("c", "to")).withColumnRenamed("c", "comp"), "comp", "left")
                   .select("id", F.coalesce("root", "comp").alias("comp")))
    return cut(tree) if tree is not None else points.sparkSession.createDataFrame([], "a long, b long, w double")


def _contract(least: int):
    """``contract_small`` in the order of height, for few edges: rows ``(kind, a, b, w)`` of points
    (0: id, seed, height), large components (1: seed, height) and edges among them (2)."""
    def run(t: pa.Table) -> pa.Table:
        edges = t.to_pandas().sort_values(["w", "a", "b"])
        ids = np.unique(np.concatenate([edges.a, edges.b]))
        a, b = np.searchsorted(ids, edges.a), np.searchsorted(ids, edges.b)
        up, members, seed, out = list(range(len(ids))), [[i] for i in range(len(ids))], [None] * len(ids), []

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, j, w in zip(a, b, edges.w):
            i, j = root(i), root(j)
            if seed[i] is None and seed[j] is not None:
                i, j = j, i
            if seed[i] is not None and seed[j] is not None:
                out.append((2, seed[i], seed[j], w))
            elif seed[i] is not None:
                out += [(0, int(ids[k]), seed[i], w) for k in members[j]]
            else:
                members[i] = members[i] + members[j]
                if len(members[i]) >= least:
                    seed[i] = int(ids[min(members[i])])
                    out.append((1, seed[i], None, w))
                    out += [(0, int(ids[k]), seed[i], w) for k in members[i]]
            members[j] = []
            up[j] = i
        kind, x, y, w = zip(*out) if out else ((), (), (), ())
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "w": pa.array(w, pa.float64())})
    return run


def contract_small(points: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts components of fewer than ``least`` points: ``(id, seed, height)`` of the points
    that end in a large one (at ``height``, hanging on the component that grew from ``seed``),
    the large ones ``(seed, height)``, and the tree's edges ``(a, b, w)`` among them."""
    if tree.count() <= FEW:
        done = cut(tree.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _contract(least)(t.drop_columns("one") if "one" in t.column_names else t),
                                                                    "kind int, a long, b long, w double"))
        return done.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("seed"), F.col("w").alias("height")), \
            done.where("kind = 1").select(F.col("a").alias("seed"), F.col("w").alias("height")), \
            done.where("kind = 2").select("a", "b", "w")
    nodes = cut(points.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"),
                              F.lit(None).cast("double").alias("height")))   # of the large: where it became so
    member = cut(points.select("id", F.col("id").alias("node"), F.lit(None).cast("double").alias("height")))
    edges = tree
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), "w").unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to"), "w"))
        # the shortest edge of each small node, in one order for both ends
        mine = both.join(nodes.where("height is null").select("node"), "node", "left_semi").groupBy("node").agg(
            F.min(F.struct("w", F.least("node", "to").alias("lo"), F.greatest("node", "to").alias("hi"), "to")).alias("m")) \
            .select("node", "m.w", "m.to")
        large = nodes.where("height is not null").select(F.col("node").alias("to"), F.lit(True).alias("large"))
        mine = cut(mine.join(large, "to", "left").select("node", "w", "to", F.coalesce("large", F.lit(False)).alias("large")))
        if mine.isEmpty():
            seeds = nodes.where("height is not null").select(F.col("node").alias("seed"), "height")
            return member.where("height is not null").select("id", F.col("node").alias("seed"), "height"), seeds, edges
        # chains end at a large node, at which all their nodes hang, or at a pair of small ones that merge
        end = roots(mine.select(F.col("node").alias("c"), "to")).withColumnRenamed("c", "node")
        is_large = large.select(F.col("to").alias("root"), "large")
        ended = mine.drop("large").join(end, "node").join(is_large, "root", "left").select(
            "node", "w", "to", "root", F.coalesce("large", F.lit(False)).alias("hangs"))
        # a pair: two that point at each other
        pair = ended.where("not hangs").alias("x").join(
            ended.where("not hangs").select(F.col("node").alias("to"), F.col("to").alias("back")), "to") \
            .where("back = node").select("node", "w", F.least("node", "to").alias("into"))
        moves = cut(ended.where("hangs").select("node", "w", F.col("root").alias("into"), F.lit(True).alias("hangs"))
                    .unionByName(pair.withColumn("hangs", F.lit(False))))
        # points of small nodes that hang get their height; those of a pair when it is large
        sized = nodes.join(moves, "node", "left")
        merged = sized.where("into is not null and not hangs").groupBy("into").agg(F.sum("size").alias("size"), F.max("w").alias("w")) \
            .select(F.col("into").alias("node"), "size", F.when(F.col("size") >= least, F.col("w")).alias("height"))
        grown = merged
        nodes = cut(sized.where("into is null").select("node", "size", "height").unionByName(grown))
        moved = member.where("height is null").join(moves, "node", "left").select(
            "id", F.coalesce("into", "node").alias("node"), F.when(F.col("hangs"), F.col("w")).alias("height"))
        now = moved.join(grown.select("node", F.col("height").alias("born")), "node", "left").select(
            "id", "node", F.coalesce("height", "born").alias("height"))
        member = cut(member.where("height is not null").unionByName(now))
        into = moves.select("node", "into")
        edges = cut(edges.join(into.withColumnRenamed("node", "a").withColumnRenamed("into", "ia"), "a", "left")
                    .join(into.withColumnRenamed("node", "b").withColumnRenamed("into", "ib"), "b", "left")
                    .select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"), "w").where("a <> b"))


def _cluster_tree(t: pa.Table) -> pa.Table:
    """Large components and the edges among them → clusters ``(cluster, turn, seed, parent, low,
    high, ups, tops)``: alive from height ``low`` to below ``high``, ended in the order of ``turn``;
    ``ups``: ancestors at distance 1, 2, 4, ...; ``tops``: where the one before each ends.  One
    that starts and ends at the same height is none in truth: nothing leaves it."""
    rows = t.to_pandas()
    seeds = rows[rows.kind == 0].sort_values("a")
    edges = rows[rows.kind == 1].sort_values(["w", "a", "b"])
    ids = seeds.a.to_numpy()
    low = list(seeds.w)
    parent = [-1] * len(low)
    high = [np.inf] * len(low)
    turn = [0] * len(low)
    ended = 0
    up = list(range(len(ids)))              # of components
    alive = list(range(len(ids)))           # cluster of a component's root

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    # ids of hot tables are sparse: places by search
    a, b = np.searchsorted(ids, edges.a.to_numpy()), np.searchsorted(ids, edges.b.to_numpy())
    for i, j, w in zip(a, b, edges.w):
        i, j = root(i), root(j)
        x, y = alive[i], alive[j]
        # at one height all joins are one: a cluster that starts here takes in the others
        new = next((c for c in (x, y) if c >= len(ids) and low[c] == w), len(low))
        if new == len(low):
            low.append(w)
            high.append(np.inf)
            parent.append(-1)
            turn.append(0)
        for c in (x, y):
            if c != new:
                ended += 1
                high[c], parent[c], turn[c] = w, new, ended
        up[j] = i
        alive[i] = new
    n = len(low)
    par, top = np.array(parent, np.int64), np.array(high, float)
    last = np.where(par >= 0, turn, ended + 1)
    ups, tops = [par], [top]
    while (ups[-1] >= 0).any():
        p, h = ups[-1], tops[-1]
        # the ancestor twice as far, and where the one before it ends
        ups.append(np.where(p >= 0, p[p], -1))
        tops.append(np.where(p >= 0, h[p], np.inf))
    return pa.table({"cluster": pa.array(np.arange(n)), "turn": pa.array(last.astype(np.int64)), "seed": pa.array([int(x) for x in ids] + [None] * (n - len(ids)), pa.int64()),
                     "parent": pa.array(par), "low": pa.array(np.array(low, float)), "high": pa.array(top),
                     "ups": pa.array(np.stack(ups, 1).tolist(), pa.list_(pa.int64())),
                     "tops": pa.array(np.stack(tops, 1).tolist(), pa.list_(pa.float64()))})


def _choose(t: pa.Table) -> pa.Table:
    """Clusters ``(cluster, turn, parent, low, high, points, weight)`` with the ``points`` that leave
    each and their sum of 1/height → the chosen one above or at each cluster and where it
    is born (its lower height) and ends: ``(cluster, chosen, ends, born, stability)``."""
    rows = t.to_pandas().sort_values("cluster")
    n = len(rows)
    parent, low, high = rows.parent.to_numpy(), rows.low.to_numpy(), rows.high.to_numpy()
    points, weight = rows.points.to_numpy().astype(float), rows.weight.to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        start, end = 1 / high, 1 / low
    order = np.argsort(rows.turn.to_numpy(), kind="stable")   # children end before their parents
    total, inside, best = points.copy(), np.zeros(n), np.zeros(n)
    own = np.zeros(n)
    chosen = np.zeros(n, bool)
    for c in order:
        # points that it passes on to children leave it where it ends
        passed = total[c] - points[c]
        gain = weight[c] + (passed * end[c] if passed else 0.0)
        own[c] = gain - total[c] * start[c] if high[c] > low[c] else 0.0
        if parent[c] >= 0 and own[c] > 0 and own[c] >= inside[c]:
            best[c], chosen[c] = own[c], True
        else:
            best[c] = inside[c]
        if parent[c] >= 0:
            total[parent[c]] += total[c]
            inside[parent[c]] += best[c]
    pick = np.full(n, -1, np.int64)
    for c in order[::-1]:
        above = pick[parent[c]] if parent[c] >= 0 else -1
        pick[c] = above if above >= 0 else (c if chosen[c] else -1)
    has = pick >= 0
    at = np.maximum(pick, 0)
    return pa.table({"cluster": rows.cluster.to_numpy(), "chosen": pick, "ends": np.where(has, high[at], np.nan),
                     "born": np.where(has, low[at], np.nan), "stability": own})


def hdbscan(df: DataFrame, key: str, features: Sequence[str], min_cluster_size: int = 5,
            min_samples: int | None = None) -> DataFrame:
    """Adds ``cluster`` (-1: noise; numbered by their smallest key) and ``probability`` (how soon
    a point is inside its cluster, from 0 to 1) to every row.  ``min_samples`` is
    ``min_cluster_size`` unless given.  Rows with a null, NaN or infinite feature are noise;
    rows that repeat a key, or have none, are rows of their own.  A table without two
    separate groups of ``min_cluster_size`` points is all noise."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    samples = min_cluster_size if min_samples is None else max(1, min_samples)
    dims = len(features)
    fx = [f"_x_{i}" for i in range(dims)]
    # numbered once and written: a lost executor reads the same numbers again
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    # written before the filter: beneath names of its own inputs Spark would restate the filter in every mix of them
    flat = cut(rows.select(F.col("_id").alias("id"), *[coerce_numeric(c).cast("double").alias(f) for c, f in zip(features, fx)]))
    z = cut(flat.withColumn("v", F.array(*fx)).where(usable()))
    found = nearest(z, z, "id", fx, samples + MORE)[0]
    rank = F.col("nn_rank") <= samples
    core = found.groupBy(F.col("q").alias("id")).agg(
        F.sqrt(F.max(F.when(rank, F.col("d2")))).alias("core"), F.sqrt(F.max("d2")).alias("far"), F.count(F.lit(1)).alias("listed"))
    points = cut(z.join(core, "id", "left").select(
        "id", "v", F.coalesce("core", F.lit(0.0)).alias("core"),
        F.when(F.coalesce("listed", F.lit(0)) < samples + MORE, float("inf")).otherwise(F.greatest("core", "far")).alias("beyond")))
    cores = lambda c: points.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    lists = cut(found.select(F.col("q").alias("a"), F.col("p").alias("b"), "d2").join(cores("a"), "a").join(cores("b"), "b")
                .select("a", "b", F.greatest(F.sqrt("d2"), "core_a", "core_b").alias("w")))
    tree = spanning_tree(points, lists, dims)
    left, seeds, edges = contract_small(points.select("id"), tree, min_cluster_size)
    parts = seeds.select(F.lit(0).alias("kind"), F.col("seed").alias("a"), F.lit(None).cast("long").alias("b"), F.col("height").alias("w")) \
        .unionByName(edges.select(F.lit(1).alias("kind"), "a", "b", "w"))
    clusters = cut(parts.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: _cluster_tree(t), "cluster long, turn long, seed long, parent long, low double, high double, ups array<long>, tops array<double>"))
    # every point's cluster: the one alive at its height above its seed
    at = left.join(clusters.where("seed is not null").select("seed", F.col("cluster").alias("leaf")), "seed") \
        .select("id", "height", F.col("leaf").alias("cluster"))
    steps = clusters.agg(F.max(F.size("ups"))).first()[0] or 0
    for k in reversed(range(steps)):
        jump = clusters.select("cluster", F.get("ups", F.lit(k)).alias("up"), F.get("tops", F.lit(k)).alias("top"))
        at = cut(join_small(at, jump, "cluster").select(
            "id", "height", F.when((F.col("up") >= 0) & (F.col("height") >= F.col("top")), F.col("up")).otherwise(F.col("cluster")).alias("cluster")))
    sums = at.groupBy("cluster").agg(F.count(F.lit(1)).alias("points"), F.sum(
        F.when(F.col("height") > 0, 1 / F.col("height")).otherwise(float("inf"))).alias("weight"))
    facts = clusters.join(sums, "cluster", "left").select(
        "cluster", "turn", "parent", "low", "high", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    chosen = cut(facts.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: _choose(t), "cluster long, chosen long, ends double, born double, stability double"))
    inside = at.join(chosen.where("chosen >= 0"), "cluster").where(F.col("height") < F.col("ends")).select(
        F.col("id").alias("_id"), "chosen", F.when(F.col("height") > 0, F.least(F.lit(1.0), F.col("born") / F.col("height")))
        .otherwise(1.0).alias("probability"))
    named = cut(rows.join(inside, "_id", "left"))
    names = named.where("chosen is not null").groupBy("chosen").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("_id"))).alias("m")) \
        .collect() if chosen.where("cluster = chosen").count() <= FEW else None
    if names is not None:
        order = [r["chosen"] for r in sorted(names, key=lambda r: tuple((x is None, x) for x in r["m"]))]
        numbers = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "chosen long, cluster int")
        named = join_small(named, numbers, "chosen", "left")
    else:
        named = named.withColumn("cluster", F.col("chosen").cast("int"))
    return named.select(*df.columns, F.coalesce("cluster", F.lit(-1)).alias("cluster"),
                        F.coalesce("probability", F.lit(0.0)).alias("probability"))
