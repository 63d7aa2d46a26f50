"""Ranks in the order of a hash need no search for a row's bucket."""

from pyspark.sql import functions as F

from tessera.operators import split as SP
from tessera.plans import ordering as O


def test_hash_bits_give_the_same_ranks(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id", F.lit(1)).alias("h"))
    a, b = ({r["id"]: r["_rank"] for r in O.ranked(df, ["h", "id"], by=["g"], max_groups=3, hashed=hashed).collect()} for hashed in (True, False))
    assert a == b
    assert sorted(a[i] for i in range(0, 500, 3)) == list(range(1, 168))


def test_splits_search_no_boundaries(spark, monkeypatch):
    def searched(*args, **kw):
        raise AssertionError("a search for each row")

    monkeypatch.setattr(O, "range_bucket", searched)
    df = spark.range(200).select("id", (F.col("id") % 4 == 0).alias("y"))
    got = SP.split_stratified(df, "id", "y", 0.2).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in got} == {(True, "test"): 10, (True, "train"): 40, (False, "test"): 30, (False, "train"): 120}
    folds, k = SP.assign_folds(df, "id", "stratified", 5, label="y")
    assert k == 5 and {r["count"] for r in folds.groupBy("fold").count().collect()} == {40}
