"""Correlations of all pairs of columns in one pass.

Each task adds up four matrix products of its rows (values, squares and presence), so the
table is read once however many columns there are; the tasks' sums meet per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_correlations(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """``(i, j, r)`` for i <= j over rows where both are present; r is null or NaN
    where it is undefined.  Values are centred first, so large means cost no digits."""
    d = len(values)
    rows = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    means = rows.agg(*[F.avg(F.when(F.abs(f"v{i}") < float("inf"), F.col(f"v{i}"))).alias(f"v{i}") for i in range(d)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    i, j = np.triu_indices(d)

    def run(batches):
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        some = False
        for b in batches:
            some = True
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(d)]).astype(float) - centre
            here = np.column_stack([b.column(k).is_valid().to_numpy(zero_copy_only=False) for k in range(d)]).astype(float)
            x = np.where(here > 0, x, 0.0)
            n += here.T @ here
            sx += x.T @ here
            sxx += (x * x).T @ here
            sxy += x.T @ x
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[
                    pa.array(m) for m in (n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])]],
                names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = rows.mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col
    vx = F.greatest(c("sxx") - F.try_divide(c("sx") * c("sx"), c("n")), F.lit(0.0))
    vy = F.greatest(c("syy") - F.try_divide(c("sy") * c("sy"), c("n")), F.lit(0.0))
    cov = c("sxy") - F.try_divide(c("sx") * c("sy"), c("n"))
    return sums.select("i", "j", F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("r"))
