import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.products import pair_correlations


def test_pairs_with_gaps_match_pandas(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5)) + 1e6
    x[:, 1] = x[:, 0] * 0.5 + r.normal(size=300)
    x[:, 4] = 7.0
    x[r.random((300, 5)) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in "abcde")).repartition(4)
    got = {(t.i, t.j): t.r for t in pair_correlations(df, [F.col(c) for c in "abcde"]).collect()}
    want = pdf.corr().to_numpy()
    assert len(got) == 15
    for (i, j), v in got.items():
        assert (v is None) if 4 in (i, j) else abs(v - want[i, j]) < 1e-9
    assert pair_correlations(df.where("false"), [F.col("a"), F.col("b")]).count() == 0
