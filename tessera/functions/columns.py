"""Column roles, safe casts and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def categorical_cols(df: DataFrame, exclude=()) -> list[str]:
    """Strings and booleans (the catalog's notion of categorical)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def datetime_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, TEMPORAL) and f.name not in exclude]


def roles(df: DataFrame) -> dict[str, list[str]]:
    return {"numeric": numeric_cols(df), "categorical": categorical_cols(df),
            "datetime": datetime_cols(df)}


def to_double(col) -> Column:
    """``try_cast`` to double with NaN normalised to null (ANSI-safe)."""
    c = F.col(col) if isinstance(col, str) else col
    d = c.try_cast("double") if hasattr(c, "try_cast") else F.expr(f"try_cast({c} as double)")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def coerce_numeric(col) -> Column:
    """Non-numeric → null → 0.0."""
    return F.coalesce(to_double(col), F.lit(0.0))


def chunks(items: list, size: int = 200):
    """Split generated aggregate expressions to stay under codegen limits."""
    for i in range(0, len(items), size):
        yield items[i:i + size]


def wide_agg(df: DataFrame, exprs: list[Column], size: int = 200) -> dict:
    """Run many aggregate expressions over ``df`` (chunked) and return one dict.

    The result is one row per chunk: bounded by the number of expressions,
    never by the data.
    """
    out: dict = {}
    for part in chunks(exprs, size):
        row = df.agg(*part).collect()[0]
        out.update(row.asDict())
    return out


def sample_skew(col) -> Column:
    """Bias-corrected sample skewness (pandas / DuckDB form); null below three rows."""
    n = F.count(col)
    return F.try_divide(F.skewness(col) * F.sqrt(n * (n - 1)), F.when(n > 2, n - 2))
