"""Connected components of a table of links, by alternating stars.

Large star: every vertex hangs its larger neighbours on the smallest vertex it
sees; small star: it hangs its smaller neighbours and itself there.  Repeating
both ends with every vertex hanging directly on the smallest of its component.
Each round is cut by a checkpoint; links are never collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _mark(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` for every vertex with a link to another; component
    is its smallest vertex.  Null ends and links of a vertex to itself are none."""
    e = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(root, "hi")
        small = hung.select("hi", F.col("m").alias("lo")).unionAll(
            hung.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        new = cut(small.distinct())
        now = _mark(new)
        if now == mark:
            break
        e, mark = new, now
    return e.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).unionAll(
        e.select("lo", "lo").distinct())


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Within a task: the smallest of ``range(n)`` that each is connected with by ``i - j``."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        up = np.arange(n)
        np.minimum.at(up, root[i], low)
        np.minimum.at(up, root[j], low)
        while (up[up] != up).any():
            up = up[up]
        new = up[root]
        if (new == root).all():
            break
        root = new
    return root
