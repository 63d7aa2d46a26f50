"""Series on a regular grid."""


def test_regularize_long_series(spark):
    """Each observation stands for the periods up to the next; leading nulls take the first value."""
    from tessera.operators import series as S
    rows = [("a", "2020-01-05", None), ("a", "2020-01-02", 1.0), ("a", "2020-03-09", 3.0), ("a", "2020-06-01", None),
            ("b", "2020-02-01", None), (None, "2020-01-01", 5.0), (None, "2020-03-01", 6.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, d string, v double")
    out = S.regularize(df, "d", ["v"], by=["g"], freq="M")
    assert out.columns == ["g", "d", "v"]
    got = sorted(((w["g"] or "", w["d"].month, w["v"]) for w in out.collect()), key=lambda w: w[:2])
    assert got == [("", 1, None), ("", 2, None), ("", 3, None), *[("a", m, 3.0) for m in range(1, 7)], ("b", 2, None)]
    # the grid meets no join and no pass for boundaries: one shuffle by period and one by series
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    one = sorted((w["d"].day, w["v"]) for w in S.regularize(df.where("g = 'a' and d < '2020-01-09'"), "d", ["v"]).collect())
    assert one == [(2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)]
