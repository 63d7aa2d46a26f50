"""Class balancing on training rows.

Random over/under-sampling are exact-count and repeatable: rows are ranked
inside their class by a seeded hash (skew-safe range rank), undersampling keeps
the first T, oversampling gives every row floor(T/n) copies plus one for the
first T mod n.  Copies are exploded in two levels (chunks, then rows) after a
round-robin repartition, so a tiny class blown up to billions of rows is
spread over all tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_small
from ..plans.ordering import RANK, ranked
from .columns import row_hash

COPY_CHUNK = 1_000_000


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def target_classes(counts: dict, strategy: str, kind: str) -> list:
    """Classes that are resampled under a strategy name."""
    strategy = (strategy or "auto").replace("_", " ")
    if not counts:
        return []
    mn = min(counts, key=lambda c: (counts[c], str(c)))
    mx = max(counts, key=lambda c: (counts[c], str(c)))
    if strategy == "auto":
        strategy = "not majority" if kind == "over" else "not minority"
    if strategy == "minority":
        return [mn]
    if strategy == "majority":
        return [mx]
    if strategy == "not minority":
        return [c for c in counts if c != mn]
    if strategy == "not majority":
        return [c for c in counts if c != mx]
    if strategy == "all":
        return list(counts)
    raise ValueError(f"unknown sampling strategy {strategy}")


def _ranked_in_class(df: DataFrame, label: str, key: str, seed: int, n_classes: int,
                     portable: bool) -> DataFrame:
    h = df.withColumn("_h", row_hash(key, seed, portable))
    return ranked(h, ["_h", key], by=[label], with_group_size=False, max_groups=n_classes)


def undersample(df: DataFrame, label: str, key: str, strategy: str = "auto", seed: int = 42,
                portable: bool = False) -> DataFrame:
    counts = class_counts(df, label)
    t = min(counts.values())
    classes = target_classes(counts, strategy, "under")
    r = _ranked_in_class(df, label, key, seed, len(counts), portable)
    keep = (~F.col(label).isin(classes)) | (F.col(RANK) <= t)
    return r.where(keep).drop(RANK, "_h")


def oversample(df: DataFrame, label: str, key: str, strategy: str = "auto", seed: int = 42,
               portable: bool = False) -> DataFrame:
    """Adds ``_copy`` (0 = original row)."""
    counts = class_counts(df, label)
    t = max(counts.values())
    classes = target_classes(counts, strategy, "over")
    spark = df.sparkSession
    ltype = df.schema[label].dataType.simpleString()
    plan = spark.createDataFrame(
        [(c, int(t // counts[c]), int(t % counts[c])) for c in classes if counts[c] < t],
        f"{label} {ltype}, _base long, _extra long")
    r = _ranked_in_class(df, label, key, seed, len(counts), portable)
    r = join_small(r, plan, on=label, how="left", known_rows=len(classes))
    copies = F.coalesce(F.col("_base") + F.when(F.col(RANK) <= F.col("_extra"), 1).otherwise(0),
                        F.lit(1))
    r = r.withColumn("_copies", copies).drop("_base", "_extra", RANK, "_h")
    # level 1: one row per chunk of copies; level 2: the copies of a chunk
    chunks = r.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0), ((F.col("_copies") - 1) / COPY_CHUNK).cast("long"))))
    if max((t // counts[c] for c in classes if counts[c] < t), default=1) > COPY_CHUNK:
        chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lo = F.col("_chunk") * COPY_CHUNK
    hi = F.least(F.col("_copies"), lo + COPY_CHUNK) - 1
    out = chunks.withColumn("_copy", F.explode(F.sequence(lo, hi)))
    return out.drop("_copies", "_chunk")


def balance(df: DataFrame, label: str, key: str, method: str = "oversample",
            strategy: str = "auto", seed: int = 42, features=None) -> DataFrame:
    if method in ("oversample", "random_oversample"):
        return oversample(df, label, key, strategy, seed)
    if method in ("undersample", "random_undersample"):
        return undersample(df, label, key, strategy, seed)
    if method in ("smote", "adasyn"):
        from . import neighbors
        fn = neighbors.smote if method == "smote" else neighbors.adasyn
        return fn(df, label, key, features or [], strategy=strategy, seed=seed)
    raise ValueError(f"unknown balance method {method}")
