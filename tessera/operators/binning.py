"""Rows for tree learners as weighted cells of binned features.

A tree sees a feature only through at most ``max_bins`` bins, so rows that agree in all
their bins (and their class) take the same path and have the same gradient in every round.
One pass counts them; the fit then works on cells, whose number is bounded by the bins and
not by the rows.  Nothing is left out: every row counts in its cell's weight.

Bins follow Spark's rule (midpoints between neighbouring values, a bin for each value while
these are few, equal counts beyond), but from the counts of all rows instead of a sample.
A feature with more than ``MANY`` values is cut at its exact quantiles.  Where features are
so many that hardly two rows share a cell, cells are as many as rows and weigh one each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import quantiles

#: Values of a feature that are counted one by one (their counts, of so many features at once, are
#: read by the driver); cells of one partition.
MANY, WIDE, PART = 10_000, 32, 20_000
WEIGHT = "_weight"


@dataclass
class Cells:
    """``rows``: bins ``names``, the label and ``WEIGHT``; ``bucketizer`` makes the bins of other rows."""

    rows: DataFrame
    bucketizer: Bucketizer
    names: list[str]
    n_rows: int
    n_cells: int
    max_bins: int

    def close(self) -> None:
        self.rows.unpersist()


def cuts(values: np.ndarray, counts: np.ndarray, max_bins: int) -> list[float]:
    """Thresholds between ``values`` (ascending, with ``counts``): a value up to the threshold is
    below it."""
    if len(values) < 2:
        return []
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= max_bins - 1:
        return [float(m) for m in middle]
    stride = float(counts.sum()) / max_bins
    out, target, so_far = [], stride, float(counts[0])
    for i in range(1, len(values)):
        before, so_far = so_far, so_far + float(counts[i])
        if abs(before - target) < abs(so_far - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out


def thresholds(df: DataFrame, inputs: Sequence[str], max_bins: int) -> dict[str, list[float]]:
    """The thresholds of every input; NaN lies beyond all of them, a null is left out."""
    if len(inputs) <= WIDE:
        kinds = df.agg(*[F.approx_count_distinct(c).alias(c) for c in inputs]).first()
    else:       # a group each, as a row of so many sketches is slow to make and to add up
        long = df.select(F.posexplode(F.array(*inputs)).alias("i", "v"))
        kinds = dict.fromkeys(inputs, 0) | {
            inputs[r["i"]]: r["n"] for r in long.groupBy("i").agg(F.approx_count_distinct("v").alias("n")).collect()}
    few = [c for c in inputs if (kinds[c] or 0) <= MANY]
    out: dict[str, list[float]] = {c: [] for c in inputs}
    for at in range(0, len(few), WIDE):
        some = few[at:at + WIDE]
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(some)])))
        counted: dict = {}
        for r in long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            counted.setdefault(r["i"], []).append((r["v"], r["n"]))
        for i, pairs in counted.items():
            values, counts = (np.array(x, float) for x in zip(*sorted(pairs)))
            out[some[i]] = cuts(values, counts, max_bins)
    many = [c for c in inputs if c not in few]
    if many:
        plain = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in many])
        probs = [i / max_bins for i in range(1, max_bins)]
        for r in quantiles(plain, many, probs, interpolation="nearest").collect():
            if r["value"] is not None:
                out[r["column_name"]].append(r["value"])
    return {c: sorted({t for t in found if t < math.inf}) for c, found in out.items()}


def bucketizer(inputs: Sequence[str], found: dict[str, list[float]]) -> Bucketizer:
    """Bins by ``thresholds``; NaN has a bin of its own after the last."""
    splits = []
    for c in inputs:
        # Spark's bins begin at their split, a tree's right side beyond its threshold
        inner = sorted({float(np.nextafter(t, np.inf)) for t in found[c]}) or [0.0]
        splits.append([-math.inf, *inner, math.inf])
    names = [f"_x_b{i}" for i in range(len(inputs))]
    return Bucketizer(splitsArray=splits, inputCols=list(inputs), outputCols=names, handleInvalid="keep")


def cells(df: DataFrame, inputs: Sequence[str], label: str, classes: bool, max_bins: int = 32) -> Cells:
    """``df`` (columns ``inputs`` as doubles without nulls, and ``label``) as cells.  A label that is
    a class is part of the cell; a number is averaged in it (splits by variance and squared
    loss see only sums of it)."""
    made = bucketizer(inputs, thresholds(df, inputs, max_bins))
    names = made.getOutputCols()
    # bins are numbers in order; a Bucketizer marks them as categories
    binned = made.transform(df.select(*inputs, label)).select(*[F.col(c).alias(c, metadata={}) for c in names], label)
    n = F.count(F.lit(1)).cast("double").alias(WEIGHT)
    if classes:
        rows = binned.groupBy(*names, label).agg(n)
    else:
        rows = binned.groupBy(*names).agg(F.avg(label).alias(label), n)
    rows = rows.cache()
    size = rows.agg(F.count(F.lit(1)).alias("cells"), F.sum(WEIGHT).alias("rows")).first()
    n_cells, n_rows = int(size["cells"]), int(size["rows"] or 0)
    # few partitions of a fixed order: many short jobs follow, and reruns add up alike
    even = rows.repartition(max(1, math.ceil(n_cells / PART)), *names).sortWithinPartitions(*names, label).cache()
    even.count()
    rows.unpersist()
    return Cells(even, made, names, n_rows, n_cells, max_bins)
