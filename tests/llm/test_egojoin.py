import numpy as np

from tessera.llm.egojoin import COSINE, near_duplicates


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = r.normal(size=8)
        for _ in range(60):
            rows.append(((centre + r.normal(size=8) * r.choice([0.01, 0.15, 0.5])).astype(np.float32).tolist(), c % 3))
    rows = [(i, v, k) for i, (v, k) in enumerate(rows)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(900)]  # exact copies
    rows += [(2000 + i, (np.array(rows[7][1]) * (1 + i)).tolist(), rows[7][2]) for i in range(40)]  # same direction
    odd = [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 8, 1), (3003, [1.0, None] + [0.0] * 6, 1), (3004, [float("nan")] * 8, 1),
           (3005, [float("inf")] + [0.0] * 7, 1), (3006, rows[5][1], None), (3007, [1.0, 2.0], 1), (3008, [1.0, 2.0], 1), (3009, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(6)
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= COSINE) & (np.array([k for *_, k in rows])[:, None] == np.array([k for *_, k in rows]))
    np.fill_diagonal(near, False)
    ids = np.array([i for i, *_ in rows])
    comp = ids.copy()
    while True:
        new = np.array([min(comp[k], comp[near[k]].min(initial=10**9)) for k in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(near[k].sum()), int(comp[k])) for k, i in enumerate(ids)}
    want |= {i: (0, i) for i, *_ in odd} | {3007: (1, 3007), 3008: (1, 3007)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == want


def test_empty_and_invalid_only(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 0, 1, True)]
