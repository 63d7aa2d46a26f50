"""Random forests grown on cells of binned features (:mod:`.binning`).

A tree of a forest sees each row as often as it was drawn.  Rows of one cell take the same
path, so a tree needs only how many rows of a cell it drew (and the sum of their labels,
for numbers).  Draws with replacement are Poisson(rate) for each row and tree, as in Spark's own
forests.  A class is part of the cell, so a cell of w rows is drawn Poisson(w * rate) times:
the sum of its rows' draws.  For numbers every row is drawn in one pass, as its own label counts,
and a task adds up the cells before they are sent.

Each tree is Spark's, fitted on the cells with its draws as weights; the trees are then one
forest model of Spark's.  Its work depends on the cells, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binning import PART, WEIGHT, Cells

#: Fewer rows are fitted sooner as they are than the trees one by one.
LEAST_ROWS = 300_000
#: Cells pay where so many rows share one; tree fits at a time; bytes of sums that a task holds;
#: draws at a time.
ROWS_A_CELL, AT_ONCE, HELD_BYTES, DRAWS = 10, 8, 64 << 20, 1 << 20


def pays(made: Cells) -> bool:
    """Whether rows are many, cells few against them, and one number can name each."""
    return made.n_rows >= LEAST_ROWS and made.n_cells * ROWS_A_CELL <= made.n_rows and math.prod(_bins(made)) < 2 ** 62


def _bins(made: Cells) -> list[int]:
    # a bin for each gap between splits, and that of NaN
    return [len(s) for s in made.bucketizer.getSplitsArray()]


def _times(rng, weight: np.ndarray, trees: int, rate: float, replace: bool) -> np.ndarray:
    """How often each of so many rows is drawn by each tree: (weight, trees)."""
    if replace:
        return rng.poisson(weight[:, None] * rate, (len(weight), trees)).astype(float)
    if rate >= 1.0:
        return np.repeat(weight[:, None].astype(float), trees, axis=1)
    return rng.binomial(weight.astype(np.int64)[:, None], rate, (len(weight), trees)).astype(float)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _drawn_classes(made: Cells, label: str, trees: int, rate: float, replace: bool, seed: int) -> DataFrame:
    """Cells with the draws of every tree, ``(names..., label, drawn)``."""
    names = [*made.names, label]

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            for i in range(0, b.num_rows, max(1, DRAWS // trees)):
                part = b.slice(i, max(1, DRAWS // trees))
                times = _times(rng, part.column(WEIGHT).to_numpy(), trees, rate, replace)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], _lists(times)], names=[*names, "drawn"])

    kinds = ", ".join(f"`{c}` double" for c in names)
    return made.rows.select(*names, WEIGHT).mapInArrow(run, f"{kinds}, drawn array<double>")


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sums (a row of draws and of labels each), equal codes added up."""
    code, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(sums[order], first, axis=0)


def _summed(parts, width: int, most: float):
    """Adds up a stream of ``(codes, sums)`` with different codes each; gives what it holds when
    that is ``most`` bytes."""
    code, sums, new, waiting = np.zeros(0, np.int64), np.zeros((0, width)), [], 0
    for more, values in parts:
        at = np.minimum(np.searchsorted(code, more), max(len(code) - 1, 0))
        known = code[at] == more if len(code) else np.zeros(len(more), bool)
        sums[at[known]] += values[known]
        if not known.all():
            new.append((more[~known], values[~known]))
            waiting += len(new[-1][0])
        if 4 * waiting > len(code):
            code, sums = _added([(code, sums), *new])
            new, waiting = [], 0
            if len(code) * width * 8 > most:
                yield code, sums
                code, sums = code[:0], sums[:0]
    if waiting or len(code):
        yield _added([(code, sums), *new])


def _drawn_numbers(binned: DataFrame, made: Cells, label: str, trees: int, rate: float, replace: bool, seed: int) -> DataFrame:
    """Rows → cells with the number of rows each tree drew and the sum of their labels,
    ``(names..., drawn, sums)``."""
    names, bins = made.names, _bins(made)

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])

        def parts():
            for b in batches:
                for i in range(0, b.num_rows, max(1, DRAWS // trees)):
                    part = b.slice(i, max(1, DRAWS // trees))
                    code = np.zeros(part.num_rows, np.int64)
                    for c, n in zip(names, bins):
                        code = code * n + part.column(c).to_numpy().astype(np.int64)
                    times = _times(rng, np.ones(len(code)), trees, rate, replace)
                    y = part.column(label).to_numpy(zero_copy_only=False)
                    yield _added([(code, np.hstack([times, times * y[:, None]]))])
        for code, sums in _summed(parts(), 2 * trees, HELD_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(code), _lists(sums)], names=["code", "both"])

    def add(batches):
        def parts():
            for b in batches:
                if b.num_rows:
                    yield _added([(b.column("code").to_numpy(), b.column("both").flatten().to_numpy().reshape(-1, 2 * trees))])
        for code, sums in _summed(parts(), 2 * trees, math.inf):
            place = []
            for n in reversed(bins):
                code, at = np.divmod(code, n)
                place.append(pa.array(at.astype(float)))
            yield pa.RecordBatch.from_arrays([*reversed(place), _lists(sums)], names=[*names, "both"])

    partly = binned.select(*names, label).mapInArrow(draw, "code long, both array<double>")
    # a partition's cells are held by a task
    parts = max(1, math.ceil(made.n_cells / PART), math.ceil(made.n_cells * 16 * trees / (HELD_BYTES // 4)))
    kinds = ", ".join(f"`{c}` double" for c in names)
    whole = partly.repartition(parts, "code").mapInArrow(add, f"{kinds}, both array<double>")
    return whole.select(*names, F.slice("both", 1, trees).alias("drawn"), F.slice("both", trees + 1, trees).alias("sums"))


def fit_forest(est, made: Cells, binned: DataFrame, label: str, features: str):
    """A forest model of ``est`` (an estimator of Spark's) from ``made`` (cells of the rows ``binned``)."""
    trees, rate, replace, seed = est.getNumTrees(), est.getSubsamplingRate(), est.getBootstrap(), est.getSeed()
    classes = isinstance(est, RandomForestClassifier)
    drawn = _drawn_classes(made, label, trees, rate, replace, seed) if classes else \
        _drawn_numbers(binned, made, label, trees, rate, replace, seed)
    columns = [F.get("drawn", F.lit(t)).alias(f"_n{t}") for t in range(trees)]
    columns += [F.col(label)] if classes else [F.try_divide(F.get("sums", F.lit(t)), F.get("drawn", F.lit(t))).alias(f"_y{t}") for t in range(trees)]
    assemble = VectorAssembler(inputCols=made.names, outputCol=features, handleInvalid="keep")
    parts = max(1, math.ceil(made.n_cells / PART))
    # of a fixed order, as draws of cells in a task follow it
    rows = assemble.transform(drawn).select(*made.names, features, *columns)
    rows = rows.coalesce(parts).sortWithinPartitions(*made.names, *([label] if classes else [])).drop(*made.names).cache()
    totals = rows.agg(*[F.sum(f"_n{t}").alias(f"_n{t}") for t in range(trees)]).first()
    strategy = est.getFeatureSubsetStrategy()
    if strategy == "auto":      # what it means to a forest: a single tree takes all
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    least = est.getMinInstancesPerNode()
    seeds = np.random.default_rng(seed).integers(1, 2 ** 31, trees)

    def one(t):
        tree = est.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setFeatureSubsetStrategy(strategy) \
            .setSeed(int(seeds[t])).setWeightCol(WEIGHT).setMinInstancesPerNode(1) \
            .setMaxBins(max(2, est.getMaxBins() + 1, math.ceil(math.sqrt(made.n_cells)) + 1))
        if least > 1:           # so many rows, which a cell holds by its weight
            share = (least - 0.5) / max(totals[t], 1.0)
            tree = tree.setMinWeightFractionPerNode(share) if share < 0.5 else tree.setMaxDepth(0)
        given = rows.select(features, (F.col(label) if classes else F.col(f"_y{t}")).alias(label), F.col(f"_n{t}").alias(WEIGHT))
        return tree.fit(given.where(F.col(WEIGHT) > 0))

    with ThreadPoolExecutor(max_workers=AT_ONCE) as ex:
        fitted = list(ex.map(one, range(trees)))
    rows.unpersist()
    return joined(est, fitted, classes)


def joined(est, fitted: Sequence, classes: bool):
    """One forest model with the trees of all ``fitted``."""
    sc = SparkSession.getActiveSession().sparkContext
    kind = "classification" if classes else "regression"
    of = getattr(sc._jvm.org.apache.spark.ml, kind)
    name = "Classification" if classes else "Regression"
    trees = [t for m in fitted for t in m._java_obj.trees()]
    array = sc._gateway.new_array(getattr(of, f"DecisionTree{name}Model"), len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    forest = getattr(of, f"RandomForest{name}Model")
    if classes:
        made = RandomForestClassificationModel(forest(est.uid, array, fitted[0].numFeatures, max(m.numClasses for m in fitted)))
    else:
        made = RandomForestRegressionModel(forest(est.uid, array, fitted[0].numFeatures))
    made._resetUid(est.uid)
    return est._copyValues(made)
