"""Univariate forests of groups: many rows are looked up, few walk down the trees."""

import numpy as np

from tessera.operators import anomaly as A


def forest(values, n_trees=20, depth=5, seed=3):
    r = np.random.default_rng(seed)
    return A.Forest.of([A._grow_tree(r.choice(values, 32, replace=False)[:, None], r, depth) for _ in range(n_trees)])


def test_steps_are_the_walk():
    values = np.round(np.random.default_rng(1).normal(0, 3, 400), 1)
    f = forest(values)
    cuts, lengths = f.steps(5)
    x = np.concatenate([values, cuts, np.nextafter(cuts, -np.inf), [-1e300, 1e300]])
    assert len(lengths) == len(cuts) + 1
    assert (lengths[np.searchsorted(cuts, x, "right")] == f.mean_length(x[:, None], 5)).all()


def test_many_rows_do_not_walk(spark, monkeypatch):
    """20,000 rows a group: the rows that walk down the trees are bounded by the thresholds."""
    walked = spark.sparkContext.accumulator(0)
    plain = A.Forest.mean_length

    def counted(self, X, depth, step=4096):
        walked.add(len(X))
        return plain(self, X, depth, step)

    monkeypatch.setattr(A.Forest, "mean_length", counted)
    r = np.random.default_rng(7)
    rows = [(g, i, float(v)) for g in ("a", "b") for i, v in enumerate(np.round(r.normal(0, 1, 20_000), 4))]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(3)
    got = A.grouped_forest(df, ["g"], "id", "x", n_trees=5, sample_size=64, contamination=0.1).collect()
    assert len(got) == 40_000 and walked.value < 20_000
    for g in ("a", "b"):
        part = [w for w in got if w["g"] == g]
        flagged = sum(w["is_anomaly"] for w in part)
        assert flagged <= 2_000 and all((w["score"] < 0) == w["is_anomaly"] for w in part)
        # the limit is the interpolated 0.9 quantile
        s = np.array([-w["score"] for w in part])
        assert abs(np.quantile(s, 0.9)) < 1e-12
