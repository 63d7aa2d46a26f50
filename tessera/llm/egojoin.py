"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other.  The
vectors of one label are rotated to their principal axes (a rotation keeps
distances), get the grid cell (side eps) of their leading axes, and are sorted by
label and cell: the epsilon grid order.  Runs of that order are stored as blocks
with their bounding boxes on all axes.

Blocks that a box distance above eps proves distant are never paired.  A pair of
blocks is joined recursively: intervals of the two sequences that are provably
distant are skipped, intervals that lie within eps as a whole link completely
without a comparison, small ones are compared by a matrix product, all others are
halved.  Links are counted where they are found, and only a spanning forest of them
leaves the pair, so dense groups never emit their pairs.

Equal vectors of one label collapse first and count by their number.  Inputs and
results: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors with a null label or a null id, link with nothing (component: their own
id, kept); vectors of different length never link; rows that repeat an id are
vectors of their own, with one component if they link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ints, pack, store, table
from .links import components, roots

COSINE, BLOCK, LEAF, CELLS = 0.93, 512, 48, 6
#: Slack for rounding: what is nearer to eps than this is compared, not assumed.
SLACK = 1e-9


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes of the vectors ``(v array<double>)``, at unit length, of one dimension, largest variance
    first.  Their dims * dims second moments are added up in Spark."""
    def moments(batches):
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            x = _matrix(b.column("v"), dims)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.select("v").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    m = np.array([r["x"] for r in rows]).reshape(dims + 1, dims + 1)
    n = max(m[-1, -1], 1.0)
    mean = m[:-1, -1] / n
    _, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1]


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _place(axes: np.ndarray, eps: float):
    """Unit vectors in principal axes, and their cell as a string that sorts like the cells."""
    dims = len(axes)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), dims)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
            cell = np.floor(x[:, :CELLS] / eps).astype(np.int64) + 500
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("label"), b.column("n"), pa.array(["".join("%04d" % c for c in r) for r in cell]),
                 pa.array([pack(r) for r in x], pa.binary())], names=["rep", "label", "n", "cell", "x"])
    return run


def _blocks(dims: int):
    """Cut a partition (one label after the other, in grid order) into blocks."""
    def cut(ids, ns, xs, label, part, serial):
        x = np.frombuffer(b"".join(xs), np.float64).reshape(-1, dims)
        return (f"{part}-{serial}", label, x.min(0).tolist(), x.max(0).tolist(),
                pack(np.array(ids, np.int64)), pack(np.array(ns, np.int64)), pack(x))

    def run(batches):
        from pyspark import TaskContext
        part, serial, ids, ns, xs, label = TaskContext.get().partitionId(), 0, [], [], [], None
        for b in batches:
            out = []
            for i, lab, n, x in zip(*(b.column(c).to_pylist() for c in ("rep", "label", "n", "x"))):
                if ids and (lab != label or len(ids) == BLOCK):
                    out.append(cut(ids, ns, xs, label, part, serial))
                    serial, ids, ns, xs = serial + 1, [], [], []
                label = lab
                ids.append(i)
                ns.append(n)
                xs.append(x)
            if out:
                yield _block_batch(out)
        if ids:
            yield _block_batch([cut(ids, ns, xs, label, part, serial)])
    return run


_BLOCK = "block string, label string, low array<double>, high array<double>, ids binary, ns binary, xs binary"


def _block_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["block", "label", "low", "high", "ids", "ns", "xs"])


class Join:
    """The recursive join of two sequences (``same``: of one with itself)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, same: bool, cosine: float):
        self.x, self.y, self.nx, self.ny, self.same, self.cosine = x, y, nx, ny, same, cosine
        self.eps = (2 - 2 * cosine) ** 0.5
        self.links_x = np.zeros(len(x), np.int64)
        self.links_y = self.links_x if same else np.zeros(len(y), np.int64)
        self.edges: list[np.ndarray] = []  # (place in x, place in y)
        self._run(0, len(x), 0, len(y))

    def _box(self, a: np.ndarray):
        return a.min(0), a.max(0)

    def _run(self, a, b, c, d):
        if self.same and c < a:
            return  # the mirror image is joined
        p, q = self.x[a:b], self.y[c:d]
        (l1, h1), (l2, h2) = self._box(p), self._box(q)
        if np.sqrt((np.maximum(0, np.maximum(l1 - h2, l2 - h1)) ** 2).sum()) > self.eps + SLACK:
            return
        mid1, mid2 = (l1 + h1) / 2, (l2 + h2) / 2
        r1 = np.sqrt(((p - mid1) ** 2).sum(1).max())
        r2 = np.sqrt(((q - mid2) ** 2).sum(1).max())
        gap = np.sqrt(((mid1 - mid2) ** 2).sum())
        if gap - r1 - r2 > self.eps + SLACK:
            return
        if gap + r1 + r2 < self.eps - SLACK:
            self._all(a, b, c, d)
        elif b - a <= LEAF and d - c <= LEAF:
            self._leaf(a, b, c, d)
        else:
            m, n = (a + b) // 2, (c + d) // 2
            if b - a <= LEAF:
                self._run(a, b, c, n)
                self._run(a, b, n, d)
            elif d - c <= LEAF:
                self._run(a, m, c, d)
                self._run(m, b, c, d)
            elif self.same and a == c:
                self._run(a, m, c, n)
                self._run(a, m, n, d)
                self._run(m, b, n, d)
            else:
                for s, t in ((a, m), (m, b)):
                    for u, v in ((c, n), (n, d)):
                        self._run(s, t, u, v)

    def _all(self, a, b, c, d):
        """Every pair links: counts by sums, edges as a star around the first two."""
        if self.same and a == c and b == d:
            own = self.nx[a:b]
            self.links_x[a:b] += own.sum() - own  # copies of the same vector are counted by their class
            self._edge(np.full(b - a, a), np.arange(a, b))
            return
        self.links_x[a:b] += self.ny[c:d].sum()
        self.links_y[c:d] += self.nx[a:b].sum()
        self._edge(np.full(d - c, a), np.arange(c, d))
        self._edge(np.arange(a, b), np.full(b - a, c))

    def _leaf(self, a, b, c, d):
        p, q = self.x[a:b], self.y[c:d]
        near = (p @ q.T) / np.linalg.norm(p, axis=1)[:, None] / np.linalg.norm(q, axis=1) >= self.cosine
        if self.same and a == c and b == d:
            near[np.arange(b - a), np.arange(b - a)] = False
            self.links_x[a:b] += near @ self.ny[c:d]
        else:
            self.links_x[a:b] += near @ self.ny[c:d]
            self.links_y[c:d] += near.T @ self.nx[a:b]
        i, j = np.nonzero(near)
        self._edge(a + i, c + j)

    def _edge(self, i, j):
        if len(i):
            self.edges.append(np.stack([i, j], 1))

    def forest(self) -> np.ndarray:
        """For each vertex (places of x, then of y; only x if the same) the smallest
        place it is connected with."""
        off = 0 if self.same else len(self.x)
        e = np.concatenate([np.zeros((0, 2), np.int64), *self.edges])
        return roots(off + len(self.y), e[:, 0], e[:, 1] + off)


def _join(cosine: float, dims: int):
    def run(batches):
        for b in batches:
            rep, links, root = [], [], []
            cols = [b.column(c).to_pylist() for c in ("b1", "b2", "i1", "i2", "n1", "n2", "x1", "x2")]
            for b1, b2, i1, i2, n1, n2, x1, x2 in zip(*cols):
                same = b1 == b2
                i1, i2, n1, n2 = (np.frombuffer(z, np.int64) for z in (i1, i2, n1, n2))
                x1, x2 = (np.frombuffer(z, np.float64).reshape(-1, dims) for z in (x1, x2))
                j = Join(x1, x2, n1, n2, same, cosine)
                ids = i1 if same else np.concatenate([i1, i2])
                count = j.links_x if same else np.concatenate([j.links_x, j.links_y])
                hit = np.flatnonzero(count)
                rep.append(ids[hit])
                links.append(count[hit])
                root.append(ids[j.forest()[hit]])
            if rep:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (rep, links, root)],
                                                 names=["rep", "links", "root"])
    return run


def _joined(classes: DataFrame, dims: int, cosine: float, partitions: int) -> DataFrame:
    """(rep, links, root) of the classes ``(rep, label, n, v)`` of one length."""
    eps = (2 - 2 * cosine) ** 0.5
    axes = principal_axes(classes.select("v"), dims)
    placed = classes.select("rep", "label", "n", "v").mapInArrow(
        _place(axes, eps), "rep long, label string, n long, cell string, x binary")
    blocks = store(placed.repartitionByRange(partitions, "label", "cell", "rep").sortWithinPartitions("label", "cell", "rep")
                   .mapInArrow(_blocks(dims), _BLOCK))
    boxes = blocks.select("block", "label", "low", "high")
    # cells of the first axis that a block touches, and a neighbour's on either side
    first = lambda c: F.floor(F.col(c)[0] / eps)
    left = boxes.select(F.col("block").alias("b1"), "label", F.col("low").alias("l1"), F.col("high").alias("h1"),
                        F.explode(F.sequence(first("low") - 1, first("high") + 1)).alias("cell"))
    right = boxes.select(F.col("block").alias("b2"), "label", F.col("low").alias("l2"), F.col("high").alias("h2"),
                         F.explode(F.sequence(first("low"), first("high"))).alias("cell"))
    gap = F.aggregate(F.zip_with(F.zip_with("l1", "h2", lambda a, b: a - b), F.zip_with("l2", "h1", lambda a, b: a - b),
                                 lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, a: s + a * a)
    pairs = left.join(right, ["label", "cell"]).where("b1 <= b2").where(F.sqrt(gap) <= eps + SLACK).select("b1", "b2").distinct()
    own = lambda k: blocks.select(F.col("block").alias(f"b{k}"), F.col("ids").alias(f"i{k}"),
                                  F.col("ns").alias(f"n{k}"), F.col("xs").alias(f"x{k}"))
    return pairs.join(own(1), "b1").join(own(2), "b2").mapInArrow(_join(cosine, dims), "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """One row per row: ``id_col, n_links, component_id, kept``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0), F.lit(False))
    # a class is known by label and vector; -0.0 is 0.0
    marked = store(rows.withColumn("fine", fine).withColumn(
        "v", F.when(F.col("fine"), F.transform("v", lambda x: x + F.lit(0.0))))
        .withColumn("m1", F.when(F.col("fine"), F.xxhash64("label", "v")))
        .withColumn("m2", F.when(F.col("fine"), F.xxhash64("v", "label", F.lit(1)))))
    classes = store(marked.where("fine").groupBy("m1", "m2").agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.min_by(F.struct("label", "v"), "id").alias("own"))
        .select("m1", "m2", "first", "n", "own.label", "own.v", F.size("own.v").alias("dims"))
        .withColumn("rep", F.col("m1")))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = [r["dims"] for r in classes.select("dims").distinct().collect()]  # lengths of vectors, few
    found = None
    for dims in sorted(lengths):
        got = _joined(classes.where(F.col("dims") == dims), dims, cosine, parts)
        found = got if found is None else found.unionAll(got)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = store(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # components are known by a class; each is named by its smallest id
    known = classes.select("m1", "m2", "rep", "first", "n").join(links, "rep", "left") \
        .join(comps.select(F.col("vertex").alias("rep"), "component"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    names = known.groupBy("component").agg(F.min("first").alias("name"))
    facts = known.join(names, "component").select(
        "m1", "m2", "name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return marked.select("id", "m1", "m2").join(facts, ["m1", "m2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("name", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op5_embedding(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Pairs of one label by definition; for the small tables of the SQL check.
OP5_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS v, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id,
       coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.v = e.vec_id
"""
