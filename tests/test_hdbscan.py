"""HDBSCAN against the definition: components at every height of the whole distance matrix."""

import numpy as np
import pytest

from tessera.operators import hdbscan as H
from tessera.plans import pivots


def components(pts, reach, below):
    left, out = set(pts), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = [j for j in left if reach[i, j] < below]
            left -= set(near)
            todo += near
        out.append(seen)
    return out


def brute(x, size, samples):
    """(cluster numbered by its smallest point, probability) of every point."""
    x = np.array(x, float)
    n = len(x)
    d = np.zeros((n, n))
    for j in range(x.shape[1]):
        d += (x[:, None, j] - x[None, :, j]) ** 2
    d = np.sqrt(d)
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    clusters = []

    def grow(pts, birth, parent):
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "death": 0.0, "own": 0.0, "total": len(pts), "leave": {}, "kids": []})
        c = clusters[me]
        lam = lambda h: np.inf if h == 0 else 1 / h
        low = 0.0 if np.isinf(birth) else 1 / birth
        for h in sorted({reach[i, j] for i in pts for j in pts if i < j}, reverse=True):
            parts = components(pts, reach, h)
            big = [p for p in parts if len(p) >= size]
            gone = [i for p in parts if len(p) < size for i in p]
            for i in gone:
                c["leave"][i] = h
                c["own"] += lam(h) - low
            if len(big) != 1:
                c["death"] = h
                for p in big:
                    c["own"] += len(p) * (lam(h) - low)
                    c["kids"].append(grow(p, h, me))
                return me
            pts = big[0]
        return me

    out = {i: (-1, 0.0) for i in range(n)}
    if n < size:
        return out
    grow(list(range(n)), np.inf, None)

    def pick(k):
        c = clusters[k]
        got = [pick(j) for j in c["kids"]]
        inside = sum(g[0] for g in got)
        if c["parent"] is not None and c["own"] > 0 and c["own"] >= inside:
            return c["own"], [k]
        return inside, [j for g in got for j in g[1]]

    def under(k):
        return {**clusters[k]["leave"], **{i: h for j in clusters[k]["kids"] for i, h in under(j).items()}}

    chosen = [(under(k), clusters[k]["death"]) for k in pick(0)[1]]
    for number, (pts, death) in enumerate(sorted(chosen, key=lambda c: min(c[0]))):
        for i, h in pts.items():
            out[i] = (number, 1.0 if h == 0 else min(1.0, death / h))
    return out


def run(spark, x, size, samples=None, parts=5):
    df = spark.createDataFrame([(i, *[None if v is None else float(v) for v in p]) for i, p in enumerate(x)],
                               "k long, " + ", ".join(f"x{j} double" for j in range(len(x[0])))).repartition(parts)
    got = H.hdbscan(df, "k", [f"x{j}" for j in range(len(x[0]))], size, samples).collect()
    assert len(got) == len(x)
    return {r["k"]: (r["cluster"], r["probability"]) for r in got}


def same(got, want):
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    for i, (_, p) in want.items():
        assert got[i][1] == pytest.approx(p, abs=1e-9), i


def blobs(seed=0, dims=2):
    r = np.random.default_rng(seed)
    out = [r.normal(c, s, (n, dims)) for c, s, n in ((0, 0.3, 25), (4, 0.2, 18), (4.8, 0.1, 14), (-6, 1.0, 15))]
    return np.concatenate(out + [r.uniform(-12, 12, (10, dims))])


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small jobs: two partitions are enough to split every group."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.fixture
def small_blocks(monkeypatch):
    for k, v in (("BLOCK", 8), ("PER_PIVOT", 9), ("ASKS", 10)):
        monkeypatch.setattr(pivots, k, v)


def test_blobs_and_noise(spark, small_blocks):
    x = blobs()
    want = brute(x, 5, 5)
    assert len({c for c, _ in want.values()}) >= 4
    same(run(spark, x, 5), want)


def test_ties_copies_and_joins_without_the_driver(spark, small_blocks, monkeypatch):
    """A grid (all heights tie), a hot point and two chains; links followed by joins."""
    monkeypatch.setattr(H, "FEW", 3)
    x = [(i % 6, i // 6) for i in range(30)] + [(20.0, 20.0)] * 12 + [(40 + 1.5 ** i, 0) for i in range(9)] + \
        [(21 + i / 8, 20) for i in range(8)]
    same(run(spark, x, 4, 3), brute(x, 4, 3))


def test_components_wider_than_the_lists(spark, small_blocks, monkeypatch):
    """Far groups whose neighbours all lie inside: links come from the search."""
    monkeypatch.setattr(H, "MORE", 0)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.1, (22, 3)) for c in ((0, 0, 0), (9, 0, 0), (9, 9, 0), (30, 30, 30))])
    same(run(spark, x, 6, 2), brute(x, 6, 2))


def test_all_noise_and_unusable_rows(spark):
    assert run(spark, [(0.0, 1.0), (2.0, 2.0), (None, 1.0)], 5) == {0: (-1, 0.0), 1: (-1, 0.0), 2: (-1, 0.0)}
    assert run(spark, [(1.0, 1.0)] * 9, 3) == {i: (-1, 0.0) for i in range(9)}
    assert run(spark, [(1.0, 1.0)], 2) == {0: (-1, 0.0)}
    df = spark.createDataFrame([], "k long, x0 double")
    assert H.hdbscan(df, "k", ["x0"]).count() == 0


def test_many_features(spark, small_blocks):
    """The filter of usable rows does not multiply with the number of features (40 did not end)."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.1, (14, 40)) for c in (0, 3)]).tolist()
    x[3][2] = None
    got = run(spark, x, 5)
    assert {c for c, _ in got.values()} >= {0, 1} and all(got[i][0] in (0, -1) for i in range(14))
    assert all(got[i][0] in (1, -1) for i in range(14, 28))
