"""Exact neighbours in blocks around pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbors as NB
from tessera.plans import pivots


def frame(spark, x, groups=None, keys=None):
    rows = [((keys[i] if keys else i), (groups[i] if groups else 0), *[None if v is None else float(v) for v in p])
            for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "k long, g int, " + ", ".join(f"x{j} double" for j in range(len(x[0])))).repartition(6)


def brute(x, k, groups=None, include_self=False):
    ok = [i for i, p in enumerate(x) if all(v is not None and np.isfinite(v) for v in p) and (groups is None or groups[i] is not None)]
    out = set()
    for i in ok:
        near = []
        for j in ok:
            if (include_self or i != j) and (groups is None or groups[i] == groups[j]):
                d2 = 0.0
                for a, b in zip(x[i], x[j]):
                    d2 += (float(a) - float(b)) * (float(a) - float(b))
                near.append((d2, j))
        out |= {(i, j, r, d2) for r, (d2, j) in enumerate(sorted(near)[:k], 1)}
    return out


def found(pairs):
    return {(r["q"], r["p"], r["nn_rank"], r["d2"]) for r in pairs.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "PER_PIVOT", 12)
    monkeypatch.setattr(pivots, "ASKS", 10)
    monkeypatch.setattr(pivots, "STEP", 7)


def test_nulls_nan_and_copies_end_and_are_exact(spark, small_blocks):
    """Rows without a position have no neighbours and are none; equal points tie by key."""
    r = np.random.default_rng(1)
    x = [list(p) for p in r.normal(size=(120, 3))] + [[0.5, 0.5, 0.5]] * 60
    x += [[None, 1.0, 2.0], [0.1, float("nan"), 0.2], [float("inf"), 0.0, 0.0], [0.0, 0.0, -0.0], [0.0, 0.0, 0.0]]
    df = frame(spark, x)
    feats = ["x0", "x1", "x2"]
    assert found(NB.knn_pairs(df, df, "k", feats, 4)) == brute(x, 4)
    assert found(NB.knn_pairs(df, df, "k", feats, 4, include_self=True)) == brute(x, 4, include_self=True)


def test_groups_smaller_than_k_and_a_hot_one(spark, small_blocks):
    r = np.random.default_rng(2)
    x = r.normal(size=(230, 2)).tolist()
    groups = [0] * 180 + [1] * 2 + [2] + [3] * 27 + [None] * 20
    df = frame(spark, x, groups)
    assert found(NB.knn_pairs(df, df, "k", ["x0", "x1"], 5, by=["g"])) == brute(x, 5, groups)


def test_many_dimensions_skip_most_pairs(spark, small_blocks):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 64))
    x = (centres[r.integers(0, 20, 600)] + 0.05 * r.normal(size=(600, 64))).tolist()
    df = frame(spark, x)
    top, visits, blocks = pivots.nearest(df, df, "k", [f"x{j}" for j in range(64)], 5)
    assert found(top) == brute(x, 5)
    assert pivots.compared(visits, blocks) < 0.25 * 600 * 600


def test_other_points_than_queries(spark, small_blocks):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(50, 2)).tolist(), r.normal(size=(90, 2)).tolist()
    q, p = frame(spark, x), frame(spark, y)
    got = found(NB.knn_pairs(q, p, "k", ["x0", "x1"], 3, include_self=True))
    d2 = [[sum((a - b) * (a - b) for a, b in zip(u, v)) for v in y] for u in x]
    assert {(i, j, n) for i, j, n, _ in got} == \
        {(i, int(j), n) for i, row in enumerate(d2) for n, j in enumerate(np.argsort(row, kind="stable")[:3], 1)}


def test_no_points_and_no_queries(spark):
    df = frame(spark, [[1.0, 2.0], [None, 3.0]])
    assert found(NB.knn_pairs(df, df, "k", ["x0", "x1"], 3)) == set()
    assert found(NB.knn_pairs(df, df, "k", ["x0", "x1"], 3, include_self=True)) == {(0, 0, 1, 0.0)}
    none = df.where("false")
    assert NB.knn_pairs(none, df, "k", ["x0", "x1"], 3).count() == 0
    assert NB.knn_pairs(df, none, "k", ["x0", "x1"], 3).count() == 0


def test_partitions_do_not_matter(spark, small_blocks):
    r = np.random.default_rng(5)
    df = frame(spark, np.round(r.normal(size=(150, 2)), 1).tolist())
    one = found(NB.knn_pairs(df.coalesce(1), df, "k", ["x0", "x1"], 3))
    assert one == found(NB.knn_pairs(df.repartition(9), df.orderBy(F.desc("k")), "k", ["x0", "x1"], 3))


def test_one_coordinate_is_searched_in_order(spark, small_blocks, monkeypatch):
    """Copies, groups, windows of few values and ties by rounding; blocks only for the rest."""
    monkeypatch.setattr(NB, "IN_ORDER", 9)
    asked = []
    plain = NB.nearest
    monkeypatch.setattr(NB, "nearest", lambda q, *a, **k: asked.append(q.count()) or plain(q, *a, **k))
    r = np.random.default_rng(6)
    x = [[float(v)] for v in np.round(r.normal(size=150), 2)] + [[0.5]] * 30 + [[None], [float("nan")], [float("inf")], [-0.0], [0.0]]
    df = frame(spark, x)
    assert found(NB.knn_pairs(df, df, "k", ["x0"], 4)) == brute(x, 4)
    assert found(NB.knn_pairs(df, df, "k", ["x0"], 4, include_self=True)) == brute(x, 4, include_self=True)
    groups = [0] * 140 + [1] * 3 + [2] + [None] * 11 + [3] * 30
    df = frame(spark, x, groups)
    assert found(NB.knn_pairs(df, df, "k", ["x0"], 5, by=["g"])) == brute(x, 5, groups)
    assert sum(asked) == 0
    # squares of so small gaps are all 0: the smallest keys count, wherever they lie
    tiny = [[float(v) * 1e-200] for v in r.permutation(60)]
    df = frame(spark, tiny)
    assert found(NB.knn_pairs(df, df, "k", ["x0"], 3)) == brute(tiny, 3) and sum(asked) > 0
    # queries between the points
    some = df.where("k % 3 > 0")
    got = found(NB.knn_pairs(frame(spark, x), frame(spark, x).where("k % 3 > 0"), "k", ["x0"], 3))
    d2 = lambda i, j: (x[i][0] - x[j][0]) * (x[i][0] - x[j][0])
    ok = [i for i, v in enumerate(x) if v[0] is not None and np.isfinite(v[0])]
    assert some.count() == 40 and got == {(i, j, n, d) for i in ok for n, (d, j) in enumerate(
        sorted((d2(i, j), j) for j in ok if j % 3 and j != i)[:3], 1)}


def test_a_query_goes_once_to_a_span(spark, monkeypatch):
    """However many blocks it visits; the neighbours are those of all points."""
    monkeypatch.setattr(pivots, "BLOCK", 8)
    monkeypatch.setattr(pivots, "STEP", 50)
    x = np.random.default_rng(3).normal(size=(300, 24))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k long, " + ", ".join(f"x{j} double" for j in range(24)))
    top, visits, blocks = pivots.nearest(df, df, "k", [f"x{j}" for j in range(24)], 4)
    assert blocks.rings.count() > 30 and visits.groupBy("q", "span").count().where("count > 1").isEmpty()
    assert visits.count() <= 300 * pivots.SPANS
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r["q"], r["nn_rank"]): r["p"] for r in top.collect()}
    want = np.argsort(d, 1, kind="stable")[:, :4]
    assert got == {(i, j + 1): want[i, j] for i in range(300) for j in range(4)}
