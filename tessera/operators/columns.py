"""Projections, predicates, casts, validation and text-risk reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.columns import (NUMERIC, categorical_cols, coerce_numeric, datetime_cols,
                                 numeric_cols, to_double)


def select_by_role(df: DataFrame, role: str, exclude: Sequence[str] = ()) -> DataFrame:
    pick = {"numeric": numeric_cols, "categorical": categorical_cols,
            "datetime": datetime_cols}[role]
    return df.select(*pick(df, exclude))


def coerce_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every feature → double, non-numeric and null → 0.0 (the learners' input)."""
    return df.select(*keep, *[coerce_numeric(c).alias(c) for c in features])


def to_boolean(col: Column, dtype: T.DataType) -> Column:
    """Python truthiness: empty string / 0 → false; anything else (null too) → true."""
    if isinstance(dtype, T.StringType):
        return F.when(col.isNull(), True).otherwise(F.length(col) > 0)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(True))
    if isinstance(dtype, NUMERIC):
        return F.when(col.isNull() | F.isnan(col.cast("double")), True).otherwise(col != 0)
    return F.lit(True)


def convert_types(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Convert columns to ``numeric``/``datetime``/``category``/``string``/``boolean``.

    Unparsable values become null.  Returns ``(converted, report)``; the report
    has one row per requested column: old and new type, values that failed to
    convert, and a status (``converted``, ``missing_column``, ``unknown_type``).
    """
    exprs = {}
    meta = []
    for col, target in mapping.items():
        if col not in df.columns:
            meta.append((col, None, target, "missing_column"))
            continue
        dt = df.schema[col].dataType
        c = F.col(col)
        t = target.lower()
        if t == "numeric":
            e = to_double(c)
        elif t == "datetime":
            e = c if isinstance(dt, (T.TimestampType, T.TimestampNTZType)) else \
                F.try_to_timestamp(c.cast("string"))
        elif t in ("category", "string"):
            e = c.cast("string")
        elif t == "boolean":
            e = to_boolean(c, dt)
        else:
            meta.append((col, dt.simpleString(), target, "unknown_type"))
            continue
        exprs[col] = e
        meta.append((col, dt.simpleString(), target, "converted"))
    out = df.select(*[exprs.get(c, F.col(c)).alias(c) for c in df.columns])
    failed = [F.sum(F.when(F.col(c).isNotNull() & exprs[c].isNull(), 1).otherwise(0))
              .cast("long").alias(c) for c in exprs]
    fails = df.agg(*failed).first().asDict() if failed else {}
    spark = df.sparkSession
    report = spark.createDataFrame(
        [(c, old, new, st, int(fails.get(c, 0) or 0)) for c, old, new, st in meta],
        "column_name string, old_type string, new_type string, status string, failed long")
    return out, report


def align_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Reorder to the model's features; add absent ones as 0; coerce to double."""
    have = set(df.columns)
    return df.select(*keep, *[(coerce_numeric(c) if c in have else F.lit(0.0)).alias(c)
                              for c in features])


def validate_data(df: DataFrame, required_columns: Sequence[str] = (),
                  column_types: dict[str, str] | None = None,
                  value_ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Findings table ``(rule, column_name, level, violations, passed)``.

    Missing required column → error; expected ``numeric`` but not numeric →
    error (other type names never fail); values outside ``[min, max]`` →
    warning with the count.  One aggregate pass counts all range violations.
    """
    rows = []
    for c in required_columns:
        miss = c not in df.columns
        rows.append(("required", c, "error", int(miss), not miss))
    for c, t in (column_types or {}).items():
        if c not in df.columns:
            continue
        bad = t == "numeric" and not isinstance(df.schema[c].dataType, NUMERIC)
        rows.append(("type", c, "error", int(bad), not bad))
    ranges = {c: r for c, r in (value_ranges or {}).items() if c in df.columns}
    if ranges:
        exprs = []
        for c, (lo, hi) in ranges.items():
            x = to_double(c)
            cond = F.lit(False)
            if lo is not None:
                cond = cond | (x < F.lit(float(lo)))
            if hi is not None:
                cond = cond | (x > F.lit(float(hi)))
            exprs.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(c))
        got = df.agg(*exprs).first().asDict()
        for c in ranges:
            n = int(got[c] or 0)
            rows.append(("range", c, "warning", n, n == 0))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "rule string, column_name string, level string, "
                                       "violations long, passed boolean")


def portable_hash(key, seed: int) -> Column:
    """Seeded 31-bit hash with identical integer arithmetic in every SQL engine
    (for non-negative integer keys)."""
    k = F.col(key) if isinstance(key, str) else key
    return ((k % 2147483648) * 1103515245 + 12345 * seed) % 2147483648


def row_hash(key, seed: int, portable: bool = False) -> Column:
    if portable:
        return portable_hash(key, seed)
    k = F.col(key) if isinstance(key, str) else key
    return F.xxhash64(k, F.lit(seed))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42, portable: bool = False) -> DataFrame:
    """``n`` rows chosen uniformly by a seeded hash of ``key`` (repeatable under
    any partitioning).  Top-n per task, then one merge of n rows."""
    h = row_hash(key, seed, portable)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def top_k(df: DataFrame, col: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Largest ``k`` rows by ``col`` (TakeOrderedAndProject: bounded per task)."""
    return df.orderBy(F.col(col).desc(), *tiebreak).limit(k)


def text_risk_report(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows, and rows matching each hygiene rule, in long form
    ``(by..., rule, n_rows, n_match)``.  One aggregate, partial per task."""
    d = df.select(*by, F.col(text_col).alias("_t"))
    preds = TX.risk_predicates()
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.struct(F.lit(name).alias("rule"),
                           F.sum(F.when(p, 1).otherwise(0)).cast("long").alias("n_match"))
                  for name, p in preds]).alias("_r"))
    return agg.select(*by, "n_rows", F.inline("_r"))
