"""Train/test splits and cross-validation folds with exact, repeatable sizes.

Row order comes from a seeded hash of a key column (``xxhash64``; or a portable
integer hash that any SQL engine reproduces), so results do not depend on
partitioning.  Ranks within a class come from the skew-safe range rank in
:mod:`tessera.plans.ordering`, never from a window over a whole class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_small
from ..plans.ordering import GROUP_N, RANK, ranked
from .columns import row_hash

SPLIT = "split"
FOLD = "fold"


def _hashed(df: DataFrame, key: str, seed: int, portable: bool) -> DataFrame:
    return df.withColumn("_h", row_hash(key, seed, portable))


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                 portable: bool = False) -> DataFrame:
    """The first ceil(n·test_size) rows in hash order are ``test``."""
    n = df.count()
    n_test = int(math.ceil(n * test_size))
    r = ranked(_hashed(df, key, seed, portable), ["_h", key], with_group_size=False, hashed=not portable)
    return r.withColumn(SPLIT, F.when(F.col(RANK) <= n_test, "test").otherwise("train")) \
            .drop(RANK, "_h")


def stratified_allocation(counts: dict, n_test: int) -> dict:
    """Test rows per class: floor of the proportional share, remainder to the
    largest fractional parts (ties → class order), never more than the class."""
    n = sum(counts.values())
    exact = {c: n_test * k / n for c, k in counts.items()}
    alloc = {c: min(int(math.floor(v)), counts[c]) for c, v in exact.items()}
    rest = n_test - sum(alloc.values())
    order = sorted(counts, key=lambda c: (-(exact[c] - math.floor(exact[c])), str(c)))
    for c in order:
        if rest <= 0:
            break
        if alloc[c] < counts[c]:
            alloc[c] += 1
            rest -= 1
    return alloc


def split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42, portable: bool = False) -> DataFrame:
    """Per-class exact allocation; fewer than 2 classes → random split."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return split_random(df, key, test_size, seed, portable)
    n = sum(counts.values())
    alloc = stratified_allocation(counts, int(math.ceil(n * test_size)))
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    at = spark.createDataFrame([(k, v) for k, v in alloc.items()], f"{label} {label_type}, _alloc long")
    r = ranked(_hashed(df, key, seed, portable), ["_h", key], by=[label],
               with_group_size=False, max_groups=len(counts), hashed=not portable)
    r = join_small(r, at, on=label, how="left", known_rows=len(alloc))
    return r.withColumn(SPLIT, F.when(F.col(RANK) <= F.col("_alloc"), "test").otherwise("train")) \
            .drop(RANK, "_h", "_alloc")


def split_sequential(df: DataFrame, order: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """The first int(n·(1−test_size)) rows in ``order`` are ``train``."""
    n = df.count()
    n_train = int(n * (1 - test_size))
    r = ranked(df, list(order), with_group_size=False)
    return r.withColumn(SPLIT, F.when(F.col(RANK) <= n_train, "train").otherwise("test")) \
            .drop(RANK)


def train_test_split(df: DataFrame, key: str, method: str = "random", label: str | None = None,
                     order: Sequence[str] | None = None, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    if method == "sequential":
        return split_sequential(df, order or [key], test_size)
    if method == "stratified" and label is not None:
        return split_stratified(df, key, label, test_size, seed)
    return split_random(df, key, test_size, seed)


def _chunk_fold(rank: F.Column, n: int, k: int) -> F.Column:
    """Contiguous folds: the first n % k folds have n // k + 1 rows."""
    big = n // k + 1
    n_big = n % k
    r0 = rank - 1
    return F.when(r0 < F.lit(n_big * big), (r0 / F.lit(big)).cast("int")).otherwise(
        (F.lit(n_big) + ((r0 - F.lit(n_big * big)) / F.lit(max(n // k, 1))).cast("int"))
        .cast("int"))


def assign_folds(df: DataFrame, key: str, method: str = "kfold", k: int = 5,
                 label: str | None = None, order: Sequence[str] | None = None,
                 seed: int = 42, portable: bool = False) -> tuple[DataFrame, int]:
    """Add ``fold`` (the test fold of each row).  Returns (df, folds used).

    kfold: contiguous blocks of the hash order.  stratified: k capped to the
    smallest class (≥ 2), rank within class mod k; fewer than 2 classes or a
    class of one → kfold.  timeseries: test block n // (k+1) at the end of the
    order; rows never tested get fold −1 (they are in every training set).
    loo: one fold per row.  none: fold −1.
    """
    if method == "none":
        return df.withColumn(FOLD, F.lit(-1)), 0
    if method == "stratified" and label is not None:
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
        smallest = min(counts.values()) if counts else 0
        if len(counts) >= 2 and smallest >= 2:
            kk = max(2, min(k, smallest))
            r = ranked(_hashed(df, key, seed, portable), ["_h", key], by=[label],
                       with_group_size=False, max_groups=len(counts), hashed=not portable)
            return r.withColumn(FOLD, ((F.col(RANK) - 1) % kk).cast("int")).drop(RANK, "_h"), kk
        method = "kfold"
    n = df.count()
    if method == "loo":
        r = ranked(_hashed(df, key, seed, portable), ["_h", key], with_group_size=False, hashed=not portable)
        return r.withColumn(FOLD, (F.col(RANK) - 1).cast("int")).drop(RANK, "_h"), n
    if method == "timeseries":
        r = ranked(df, list(order or [key]), with_group_size=False)
        test = n // (k + 1)
        start = n - k * test
        f = F.when(F.col(RANK) <= start, F.lit(-1)).otherwise(
            ((F.col(RANK) - start - 1) / F.lit(max(test, 1))).cast("int"))
        return r.withColumn(FOLD, f.cast("int")).drop(RANK), k
    r = ranked(_hashed(df, key, seed, portable), ["_h", key], with_group_size=False, hashed=not portable)
    return r.withColumn(FOLD, _chunk_fold(F.col(RANK), n, k)).drop(RANK, "_h"), k


def fold_masks(fold_df: DataFrame, fold: int, method: str = "kfold") -> tuple[DataFrame, DataFrame]:
    """(train, test) DataFrames for one fold."""
    if method == "timeseries":
        return (fold_df.where(F.col(FOLD) < fold), fold_df.where(F.col(FOLD) == fold))
    return fold_df.where(F.col(FOLD) != fold), fold_df.where(F.col(FOLD) == fold)


__all__ = ["split_random", "split_stratified", "split_sequential", "train_test_split",
           "assign_folds", "fold_masks", "stratified_allocation", "GROUP_N"]
