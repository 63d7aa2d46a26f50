"""Preparation operators: invariants from the reference's data-utility tests."""

from pyspark.sql import functions as F

from tessera.operators import balance as B
from tessera.operators import encode as E
from tessera.operators import impute as I
from tessera.operators import scale as S
from tessera.operators import select as SEL
from tessera.operators import split as SP


def _with_nulls(spark):
    rows = [(1, 25.0, 50000.0, "IT", 0), (2, None, 60000.0, "HR", 1), (3, 35.0, None, None, 0),
            (4, 45.0, 80000.0, "IT", None), (5, None, 55000.0, "Sales", 1),
            (6, 30.0, 52000.0, "IT", 0), (7, 50.0, None, "HR", 1), (8, 28.0, 58000.0, None, 0),
            (9, 40.0, 70000.0, "IT", 1), (10, 33.0, 61000.0, "Sales", 0)]
    return spark.createDataFrame(rows, "id int, age double, salary double, department string, "
                                       "churn int")


def test_impute_removes_nulls(spark):
    df = _with_nulls(spark)
    for strategy in ("mean", "median", "most_frequent"):
        out = I.impute(df, strategy, num_cols=["age", "salary"], cat_cols=["department"])
        assert out.where(F.col("age").isNull() | F.col("salary").isNull()
                         | F.col("department").isNull()).count() == 0
    assert I.impute(df, "drop").count() == 4  # rows 2, 3, 4, 5, 7, 8 hold a null


def test_minmax_in_unit_interval(spark):
    df = _with_nulls(spark)
    out = S.scale(I.impute(df, "mean"), ["age", "salary"], "minmax")
    r = out.agg(F.min("age"), F.max("age"), F.min("salary"), F.max("salary")).first()
    assert r[0] == 0.0 and r[1] == 1.0 and r[2] == 0.0 and r[3] == 1.0


def test_robust_scaling_finite_with_outliers(spark):
    rows = [(i, float(i % 10), float([0, 5, -1000, 1000, 3][i % 5])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = S.scale(df, ["a", "b"], "robust")
    assert out.where(F.isnan("a") | F.isnan("b")).count() == 0


def test_one_hot_drops_first_category(spark):
    df = spark.createDataFrame([("red",), ("blue",), ("green",), (None,)], "color string")
    spec = E.fit_encode(df, ["color"])
    assert spec.output_columns() == ["color_green", "color_red"]
    out = spec.apply(df).collect()
    assert [(r["color_green"], r["color_red"]) for r in out] == [(0, 1), (0, 0), (1, 0), (0, 0)]


def test_correlated_copy_dropped(spark):
    rows = [(i, float(i % 17), float(i % 17) * 0.999 + 0.001 * (i % 3), float((i * 31) % 11))
            for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, a_copy double, c double")
    sel, _ = SEL.select_correlation(df, ["a", "a_copy", "c"], 0.9)
    assert sel == ["a", "c"]


def test_split_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    r = SP.split_random(df, "id", 0.2)
    assert r.where("split = 'test'").count() == 200
    st = SP.split_stratified(df, "id", "y", 0.2)
    got = {row["y"]: row["count"] for row in st.where("split = 'test'").groupBy("y").count().collect()}
    assert got == {0: 150, 1: 50}
    seq = SP.split_sequential(df, ["id"], 0.2)
    assert seq.where("split = 'train'").agg(F.max("id")).first()[0] == 799


def test_balance_counts(spark):
    df = spark.range(150).withColumn("y", (F.col("id") < 6).cast("int"))
    over = B.oversample(df, "y", "id")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 144, 1: 144}
    under = B.undersample(df, "y", "id")
    assert {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {0: 6, 1: 6}


def test_fill_forward_across_partitions(spark):
    rows = [(i, float(i) if i % 10 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = {r["k"]: r["v"] for r in I.fill_directional(df, ["v"], ["k"], num_partitions=7).collect()}
    assert all(out[i] == float(i - i % 10) for i in range(200))
