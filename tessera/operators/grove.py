"""Many decision trees at once, for searches and learning curves.

Each tree is grown on a subset of one table (the rows outside a fold, a share of them) with
parameters of its own, and is only asked how many rows it gets right.  A tree sees a feature
through at most ``MAX_BINS`` bins (:mod:`.binning`), so what a subset's trees need is how many
rows of each class lie in each cell of bins: a table whose size the bins bound, whatever
the number of rows.

1. The thresholds of all subsets are found together, as those of as many columns (or are known).
2. One pass over the rows adds every row to its cell in each subset, apart for the rows a tree
   learns from and those it is tested on.
3. The trees are dealt to tasks, a subset and setting each, and grown there level by level.

A tree takes the splits of Spark's own (greatest gain; of equal ones the first feature, then the
lowest split), and a tree of less depth is the beginning of a deeper one: one tree answers for
every depth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import bucketizer, thresholds

#: Spark's bins of a feature, its deepest tree and the depth of a tree where none is given.
MAX_BINS, DEEPEST, DEPTH = 32, 30, 5
#: Most numbers (cells times classes) of one subset, and of all that a task adds up; doubles of a level's sums at a time.
CELLS, HELD, SUMS = 1 << 15, 1 << 23, 1 << 22
#: Tasks of a pass for each core.
TASKS = 3


class Subset:
    """Rows to learn from (``train``) and to test on (``test``), as conditions."""

    def __init__(self, train: Column, test: Column):
        self.train, self.test = train, test


def setting(params: dict | None) -> tuple[str, int, int] | None:
    """``(criterion, least rows of a leaf, depth)``; None where these are not all, or not such that
    a tree can be grown here."""
    p = dict(params or {})
    criterion, least = p.pop("criterion", "gini"), p.pop("min_samples_leaf", 1)
    depth = p.pop("max_depth", DEPTH)
    depth = DEEPEST if depth is None else depth
    fits = not p and criterion in ("gini", "entropy") and type(least) is int and least >= 1 and \
        type(depth) is int and 0 <= depth <= DEEPEST
    return (criterion, least, depth) if fits else None


def _impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Of rows of class counts, class by class as Spark adds them up."""
    total = counts.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.ones(total.shape) if criterion == "gini" else np.zeros(total.shape)
        for k in range(counts.shape[-1]):
            share = counts[..., k] / total
            out -= share * share if criterion == "gini" else \
                np.where(counts[..., k] > 0, share * (np.log(np.where(share > 0, share, 1.0)) / math.log(2)), 0.0)
    return np.where(total > 0, out, 0.0)


def grow(train: np.ndarray, test: np.ndarray, bins: np.ndarray, criterion: str, least: int, depths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """``train`` and ``test``: rows of each class in the cells at ``bins`` → by depth, how many of
    the rows learned from and of those tested on the tree gets right."""
    n, kinds = train.shape
    train = train.astype(float)
    places, most = [], []
    for j in range(bins.shape[1]):
        values = np.unique(bins[train.sum(1) > 0, j])
        middle = (values[:-1] + values[1:]) / 2.0
        places.append(np.searchsorted(middle, bins[:, j], "left"))
        most.append(len(middle))
    at = np.zeros(n, np.int64)                      # each cell's node
    answer = [int(train.sum(0).argmax())]           # each node's class
    live = np.array([0])                            # nodes of this level that may be split
    limit = least - 0.5 if least > 1 else 0.0       # of a leaf's rows
    if least > 1 and limit / max(train.sum(), 1.0) >= 0.5:
        live = live[:0]
    out: dict[int, tuple[int, int]] = {}

    def right():
        said = np.array(answer)[at]
        return int(train[np.arange(n), said].sum()), int(test[np.arange(n), said].sum())

    for level in range(max(depths) + 1):
        if level in depths:
            out[level] = right()
        if not len(live) or level == max(depths):
            break
        number = np.full(len(answer), -1)
        number[live] = np.arange(len(live))
        mine = number[at]
        gain, feature, cut = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        lefts, rights = np.zeros((len(live), kinds)), np.zeros((len(live), kinds))
        for j, m in enumerate(most):
            if not m:
                continue
            step = max(1, SUMS // ((m + 1) * kinds))
            for lo in range(0, len(live), step):
                nodes = min(step, len(live) - lo)
                here = np.flatnonzero((mine >= lo) & (mine < lo + nodes))
                sums = np.zeros((nodes, m + 1, kinds))
                np.add.at(sums, (mine[here] - lo, places[j][here]), train[here])
                whole = sums.sum(1)
                left = np.cumsum(sums, axis=1)[:, :-1]
                other = whole[:, None] - left
                a, b, all_ = left.sum(-1), other.sum(-1), whole.sum(-1)[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = _impurity(whole, criterion)[:, None] - a / all_ * _impurity(left, criterion) - b / all_ * _impurity(other, criterion)
                g = np.where((a > 0) & (b > 0) & (a >= limit) & (b >= limit) & (g >= 0), g, -np.inf)
                first, row = g.argmax(1), np.arange(nodes)
                better = np.flatnonzero(g[row, first] > gain[lo:lo + nodes])
                to = lo + better
                gain[to], feature[to], cut[to] = g[better, first[better]], j, first[better]
                lefts[to], rights[to] = left[better, first[better]], other[better, first[better]]
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        child = np.full(len(live), -1)
        child[split] = len(answer) + 2 * np.arange(len(split))
        sides = np.stack([lefts[split], rights[split]], 1).reshape(-1, kinds)
        new = len(answer) + np.arange(len(sides))
        answer += sides.argmax(1).tolist()
        moved = np.flatnonzero((mine >= 0) & (child[mine] >= 0))
        node = mine[moved]
        stack = np.stack([p[moved] for p in places], 1) if places else np.zeros((len(moved), 0), np.int64)
        beyond = stack[np.arange(len(moved)), feature[node]] > cut[node]
        at[moved] = child[node] + beyond
        # children of one class are leaves
        live = new[np.abs(_impurity(sides, criterion)) >= np.finfo(float).eps]
    end = right()
    return {d: out.get(d, end) for d in depths}


class Grove:
    """The cells of many subsets of one table; ``scores`` grows trees on them."""

    def __init__(self, df: DataFrame, inputs: Sequence[str], label: str, kinds: int, subsets: Sequence[Subset], bins: list[Bucketizer]):
        d, n = len(inputs), len(subsets)
        splits = [[np.array(s[1:-1]) for s in b.getSplitsArray()] for b in bins]
        self.shape = [tuple(len(x) + 2 for x in s) for s in splits]     # a bin for each gap, and that of NaN
        self.kinds, shape = kinds, self.shape
        starts = np.concatenate([[0], np.cumsum([2 * kinds * math.prod(s) for s in shape])]).tolist()

        def add(batches):
            total = np.zeros(starts[-1], np.int64)
            for b in batches:
                x = [b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(d)]
                y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                for i in range(n):
                    role = b.column(f"r{i}").to_numpy(zero_copy_only=False)     # 1: to learn from, 2: to test on
                    mine = np.flatnonzero(role)
                    code = role[mine].astype(np.int64) - 1
                    for j in range(d):
                        v = x[j][mine]
                        place = np.searchsorted(splits[i][j], v, "right")
                        code = code * shape[i][j] + np.where(np.isnan(v), shape[i][j] - 1, place)
                    total[starts[i]:starts[i + 1]] += np.bincount(code * kinds + y[mine], minlength=starts[i + 1] - starts[i])
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(
                [total[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["subset", "counts"])

        def summed(t):
            total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in t.column("counts").combine_chunks())
            return pa.table({"subset": t.column("subset").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

        role = lambda s: F.when(s.train, F.lit(1)).when(s.test, F.lit(2)).otherwise(F.lit(0)).cast("byte")
        rows = df.select(*[F.col(c).alias(f"x{j}") for j, c in enumerate(inputs)], F.col(label).alias("y"),
                         *[role(s).alias(f"r{i}") for i, s in enumerate(subsets)])
        self.cells = rows.mapInArrow(add, "subset int, counts binary").groupBy("subset") \
            .applyInArrow(summed, "subset int, counts binary").cache()

    def scores(self, settings: Sequence[tuple[str, int, int]]) -> dict:
        """``{(subset, setting): (share right of the rows learned from, of those tested on)}``."""
        depths: dict = {}
        for c, least, depth in settings:
            depths.setdefault((c, least), set()).add(depth)
        asked, shape, kinds = sorted(depths.items()), self.shape, self.kinds

        def run(batches):
            for b in batches:
                for subset, counts, which in zip(*(b.column(c) for c in ("subset", "counts", "which"))):
                    (c, least), wanted = asked[which.as_py()]
                    i = subset.as_py()
                    both = np.frombuffer(counts.as_buffer(), np.int64).reshape(2, -1, kinds)
                    some = np.flatnonzero(both.sum((0, 2)))
                    bins = np.stack(np.unravel_index(some, shape[i]), 1)
                    train, test = both[0, some], both[1, some]
                    got = grow(train, test, bins, c, least, sorted(wanted))
                    sizes = int(train.sum()), int(test.sum())
                    yield pa.RecordBatch.from_pylist([{"subset": i, "which": which.as_py(), "depth": d, "train": hits[0] / sizes[0] if sizes[0] else 0.0,
                                                       "test": hits[1] / sizes[1] if sizes[1] else 0.0} for d, hits in got.items()],
                                                     pa.schema([("subset", pa.int32()), ("which", pa.int32()), ("depth", pa.int32()),
                                                                ("train", pa.float64()), ("test", pa.float64())]))

        spark = self.cells.sparkSession
        jobs = self.cells.crossJoin(F.broadcast(spark.range(len(asked)).select(F.col("id").cast("int").alias("which"))))
        trees = len(self.shape) * len(asked)
        grown = jobs.repartition(min(trees, max(1, spark.sparkContext.defaultParallelism)), "subset", "which").mapInArrow(
            run, "subset int, which int, depth int, train double, test double")
        return {(r["subset"], (*asked[r["which"]][0], r["depth"])): (r["train"], r["test"]) for r in grown.collect()}

    def close(self) -> None:
        self.cells.unpersist()


def dense(df: DataFrame) -> DataFrame:
    """``df`` in at most ``TASKS`` partitions a core."""
    return df.coalesce(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def plant(df: DataFrame, inputs: Sequence[str], label: str, kinds: int, subsets: Sequence[Subset],
          bins: list[Bucketizer] | None = None) -> Grove | None:
    """The cells of ``subsets`` of ``df`` (``inputs`` as doubles without nulls, ``label`` from 0 to
    ``kinds`` - 1); None where a subset may have more than ``CELLS`` of them, all together more than
    ``HELD``, or none to learn from.  ``bins``: those of each subset, if known."""
    bound = 2 * kinds * (MAX_BINS + 2) ** len(inputs)
    if not kinds or not subsets or bound > 2 * CELLS or bound * len(subsets) > HELD:
        return None
    # several short passes follow, in which a partition of few rows costs more than its rows
    df = dense(df)
    empty = df.agg(*[F.count_if(s.train).alias(f"n{i}") for i, s in enumerate(subsets)]).first()
    if not all(empty):
        return None
    if bins is not None:
        return Grove(df, inputs, label, kinds, subsets, bins)
    names = [[f"s{i}_{j}" for j in range(len(inputs))] for i in range(len(subsets))]
    masked = df.select(*[F.when(s.train, F.col(c)).alias(a) for s, own in zip(subsets, names) for a, c in zip(own, inputs)])
    cut = thresholds(masked, [a for own in names for a in own], MAX_BINS)
    return Grove(df, inputs, label, kinds, subsets, [bucketizer(inputs, {c: cut[a] for a, c in zip(own, inputs)}) for own in names])
