import hashlib
import random

import numpy as np
import pytest

from tessera.llm.bitplanes import cluster, nearest, products, to_planes


def brute(rows, k=8, rounds=10, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(q) for _, q in start[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    own = lambda: [min((dist(q, c), j) for j, c in enumerate(cents)) for _, q in kept]
    for _ in range(rounds):
        of = own()
        for j in range(len(cents)):
            here = [q for (_, q), (_, c) in zip(kept, of) if c == j]
            if here:
                cents[j] = [sum(x) // len(here) for x in zip(*here)]
    of = own()
    total = [sum(d for d, c in of if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0), j, d, total[j], sum(total), sha[j]) for (i, _), (d, j) in zip(kept, of))


def found(df):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<double>, planes string, cluster int").repartition(4)


def some(n=90, seed=2):
    r = random.Random(seed)
    base = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(base)]) for i in range(n)]
    rows += [rows[3], rows[3], (5, [0.0] * 64), (None, [0.25] * 64), (None, [-0.25] * 64), (200, [-1e-9] * 64)]
    return rows + [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63),
                   (305, [float("nan")] + [1.0] * 63), (306, [float("inf")] + [1.0] * 63)]


def test_products_are_exact():
    r = np.random.default_rng(0)
    for planes, top in ((2, 2), (11, 1 << 10), (28, 1 << 27)):
        x, c = r.integers(-top, top, (50, 64)), r.integers(-top, top, (3, 64))
        px, pc = to_planes(x, planes), to_planes(c, planes)
        assert (products(px, pc[0]) == x @ c[0]).all() and (products(px, px) == (x * x).sum(1)).all()
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own, dist = nearest(px, pc)
        assert (own == d.argmin(1)).all() and (dist == d.min(1)).all()


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (200, 4)])
def test_against_brute_force(spark, k, rounds):
    rows = some()
    assert found(cluster(table(spark, rows), k=k, rounds=rounds)) == brute(rows, k, rounds)


def test_large_components_and_an_empty_cluster(spark):
    rows = [(i, [float((-1) ** (i + j) * (100_000 - i)) for j in range(64)]) for i in range(12)] + [(20, [1.0] * 64)] * 9
    assert found(cluster(table(spark, rows))) == brute(rows)
    with pytest.raises(ValueError, match="would not fit"):
        cluster(table(spark, [(1, [2e5] * 64)]))


def test_same_for_any_partitions(spark):
    df = table(spark, some())
    assert found(cluster(df.coalesce(1))) == found(cluster(df.repartition(7)))


def test_empty(spark):
    got = cluster(table(spark, []))
    assert got.count() == 0
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


def test_float_vectors(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in some()[:60]]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert found(cluster(df)) == brute(rows)
