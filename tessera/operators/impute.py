"""Imputation and missing-value handling.

Fit steps collect one value per column (bounded); apply steps are lazy
``coalesce`` expressions.  The mode is found with a distributed
``groupBy(column, value)`` (partial counts per task, so a hot value costs one
row per task) followed by ``min_by`` on ``(-count, value)``: ties → smallest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_cols, string_cols
from ..plans.joins import join_small
from ..plans.ordering import long_values, quantile_table, range_bucket


def _null_counts(df: DataFrame, cols: Sequence[str]) -> dict:
    if not cols:
        return {}
    exprs = []
    for c in cols:
        isnull = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            isnull = isnull | F.isnan(c)
        exprs.append(F.sum(F.when(isnull, 1).otherwise(0)).alias(c))
    row = df.agg(*exprs).first().asDict()
    return {c: int(row[c] or 0) for c in cols}


def column_modes(df: DataFrame, cols: Sequence[str], numeric: bool) -> dict:
    """Most frequent non-null value per column (ties → smallest); None if empty."""
    if not cols:
        return {}
    lv = long_values(df, cols, value_type="double" if numeric else "string") \
        .where(F.col("value").isNotNull())
    vc = lv.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = vc.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode")).collect()
    got = {r["column_name"]: r["mode"] for r in top}
    return {c: got.get(c) for c in cols}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict:
    if not cols:
        return {}
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first().asDict()
    return {c: row[c] for c in cols}


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    qt = quantile_table(df, list(cols), [0.5], "linear")
    return {c: qt[c].get(0.5) for c in cols}


@dataclass
class ImputeSpec:
    fills: dict = field(default_factory=dict)
    drop_rows: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.drop_rows:
            return df.dropna("any")
        out = []
        for c in df.columns:
            if c in self.fills:
                v = self.fills[c]
                col = F.col(c)
                if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                    col = F.when(F.isnan(c), None).otherwise(col)
                if isinstance(v, str):
                    out.append(F.coalesce(col, F.lit(v)).alias(c))
                else:
                    out.append(F.coalesce(col.cast("double"), F.lit(float(v))).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


def fit_impute(df: DataFrame, num_cols: Sequence[str] | None = None,
               cat_cols: Sequence[str] | None = None, strategy: str = "mean") -> ImputeSpec:
    """``mean`` (also ``auto``/empty), ``median``, ``most_frequent``, ``drop``.

    Numeric columns follow the strategy; categorical columns always take
    their mode (``"missing"`` when a column has no value) except under ``drop``.
    Only columns that contain nulls are touched.
    """
    strategy = strategy or "mean"
    if strategy == "auto":
        strategy = "mean"
    if strategy == "drop":
        return ImputeSpec(drop_rows=True)
    num_cols = list(num_cols) if num_cols is not None else numeric_cols(df)
    cat_cols = list(cat_cols) if cat_cols is not None else string_cols(df)
    nulls = _null_counts(df, num_cols + cat_cols)
    num = [c for c in num_cols if nulls.get(c)]
    cat = [c for c in cat_cols if nulls.get(c)]
    fills: dict = {}
    if strategy == "median":
        stats = column_medians(df, num)
    elif strategy == "most_frequent":
        stats = {c: (v if v is not None else 0.0) for c, v in column_modes(df, num, True).items()}
    else:
        stats = column_means(df, num)
    fills.update({c: v for c, v in stats.items() if v is not None})
    fills.update({c: (v if v is not None else "missing")
                  for c, v in column_modes(df, cat, False).items()})
    return ImputeSpec(fills=fills)


def impute(df: DataFrame, strategy: str = "mean", num_cols=None, cat_cols=None) -> DataFrame:
    return fit_impute(df, num_cols, cat_cols, strategy).apply(df)


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share exceeds ``threshold``."""
    n = df.count()
    nulls = _null_counts(df, df.columns)
    drop = [c for c in df.columns if n and nulls[c] / n > threshold]
    return df.drop(*drop), drop


def fill_directional(df: DataFrame, cols: Sequence[str], order: Sequence[str],
                     by: Sequence[str] = (), direction: str = "forward",
                     num_partitions: int | None = None) -> DataFrame:
    """Forward (last non-null before), backward (next non-null after) or
    ``both`` (forward, then backward for the leading nulls) fill in ``order``
    within ``by`` groups, without putting a group into one task.

    Rows get deterministic range buckets on ``(by, order)``; each bucket fills
    locally (windows on ``(by, bucket)``), and a carry table with the last /
    first non-null value of every (group, bucket) — at most buckets + groups
    rows — fills the head (tail) of the neighbouring buckets.  ``order``
    should end with a unique key so results repeat exactly.
    """
    by = list(by)
    cols = list(cols)
    dirs = ["forward", "backward"] if direction == "both" else [direction]
    okeys = [F.col(o) for o in order]
    bucket, nb = range_bucket(df, [F.col(b) for b in by] + okeys, num_partitions)
    d = df.withColumn("_b", bucket)
    ostruct = F.struct(*[F.col(o) for o in order])
    local_cols, carry_aggs = [], []
    for dr in dirs:
        fwd = dr == "forward"
        oc = okeys if fwd else [k.desc() for k in okeys]
        w = Window.partitionBy(*by, "_b").orderBy(*oc).rowsBetween(Window.unboundedPreceding, 0)
        local_cols += [F.last(c, ignorenulls=True).over(w).alias(f"_f{dr[0]}_{c}") for c in cols]
        pick = F.max_by if fwd else F.min_by
        carry_aggs += [pick(F.col(c), F.when(F.col(c).isNotNull(), ostruct)).alias(f"_c{dr[0]}_{c}")
                       for c in cols]
    local = d.select("*", *local_cols)
    carry = d.groupBy(*by, "_b").agg(*carry_aggs)
    carry_out = []
    for dr in dirs:
        fwd = dr == "forward"
        cw = Window.partitionBy(*by).orderBy(F.col("_b") if fwd else F.col("_b").desc()) \
            .rowsBetween(Window.unboundedPreceding, -1)
        carry_out += [F.last(f"_c{dr[0]}_{c}", ignorenulls=True).over(cw).alias(f"_p{dr[0]}_{c}")
                      for c in cols]
    carry = carry.select(*by, "_b", *carry_out)
    out = join_small(local, carry, on=[*by, "_b"], how="left",
                     known_rows=nb if not by else None)

    def filled(c):
        parts = []
        for dr in dirs:
            parts += [F.col(f"_f{dr[0]}_{c}"), F.col(f"_p{dr[0]}_{c}")]
        return F.coalesce(*parts).alias(c)

    return out.select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def handle_missing(df: DataFrame, strategy: str = "auto", numeric_strategy: str = "mean",
                   categorical_strategy: str = "mode", threshold: float = 0.5,
                   order: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """``auto``/``drop`` drop sparse columns; ``auto``/``fill`` fill the rest:
    numeric by mean/median/mode/forward_fill/backward_fill, categorical by mode
    (``unknown`` when empty) / constant ``unknown`` / drop rows."""
    info: dict = {"dropped_columns": []}
    out = df
    if strategy in ("auto", "drop"):
        out, dropped = drop_sparse_columns(out, threshold)
        info["dropped_columns"] = dropped
    if strategy in ("auto", "fill"):
        num = numeric_cols(out)
        cat = string_cols(out)
        nulls = _null_counts(out, num + cat)
        num = [c for c in num if nulls.get(c)]
        cat = [c for c in cat if nulls.get(c)]
        if numeric_strategy in ("forward_fill", "backward_fill"):
            if not order:
                raise ValueError("forward/backward fill needs an order column")
            out = fill_directional(out, num, order, direction="forward"
                                   if numeric_strategy == "forward_fill" else "backward")
        elif num:
            if numeric_strategy == "median":
                stats = column_medians(out, num)
            elif numeric_strategy == "mode":
                stats = {c: (v if v is not None else 0.0)
                         for c, v in column_modes(out, num, True).items()}
            else:
                stats = column_means(out, num)
            out = ImputeSpec({c: v for c, v in stats.items() if v is not None}).apply(out)
        if categorical_strategy == "drop":
            if cat:
                out = out.dropna(subset=cat)
        elif categorical_strategy == "constant":
            out = ImputeSpec({c: "unknown" for c in cat}).apply(out)
        elif cat:
            modes = column_modes(out, cat, False)
            out = ImputeSpec({c: (v if v is not None else "unknown")
                              for c, v in modes.items()}).apply(out)
    return out, info
