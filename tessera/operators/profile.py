"""Profiling and exploration.

Every statistic of every column is generated into *one* aggregate (chunked
at 200 expressions); the per-column result rows are produced by ``inline`` on
the aggregate's single output row, so the data never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, TEMPORAL, chunks, numeric_cols, string_cols, to_double
from ..plans.joins import join_small
from ..plans.ordering import RANK, long_values, quantiles, ranked
from ..plans.products import pair_correlations


def _structs_agg(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One aggregate per chunk of per-column structs → one row per column."""
    parts = [df.agg(F.array(*part).alias("_a")).select(F.inline("_a")) for part in chunks(structs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                     digits: int = 4) -> DataFrame:
    """count, null_count, mean, sample std, min, 25/50/75 % (nearest rank), max."""
    cols = list(cols) if cols else numeric_cols(df)
    structs = []
    for c in cols:
        x = F.col(c).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count(x).alias("count"),
            (F.count(F.lit(1)) - F.count(x)).alias("null_count"),
            F.round(F.avg(x), digits).alias("mean"),
            F.round(F.stddev_samp(x), digits).alias("std"),
            F.round(F.min(x), digits).alias("min"),
            F.round(F.max(x), digits).alias("max")))
    stats = _structs_agg(df, structs)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], interpolation="nearest", approx=approx)
    qw = q.groupBy("column_name").agg(
        *[F.round(F.max(F.when(F.col("prob") == p, F.col("value"))), digits).alias(n)
          for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    out = join_small(stats, qw, on="column_name", how="left", known_rows=len(cols))
    return out.select("column_name", "count", "null_count", "mean", "std", "min",
                      "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per string column: distinct values (null counts as one), most frequent
    value (ties → smallest) and its frequency."""
    cols = list(cols) if cols else string_cols(df)
    lv = long_values(df, cols, value_type="string")
    vc = lv.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").alias("freq"))


def missing_report(df: DataFrame, digits: int = 2) -> DataFrame:
    """Null count and percentage (denominator max(rows, 1)) per column."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    structs = []
    for f in df.schema.fields:
        isnull = F.col(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            isnull = isnull | F.isnan(f.name)
        cnt = F.sum(F.when(isnull, 1).otherwise(0)).cast("long")
        structs.append(F.struct(F.lit(f.name).alias("column_name"),
                                cnt.alias("null_count"),
                                F.round(cnt / n * 100.0, digits).alias("null_pct")))
    return _structs_agg(df, structs)


def shape_and_dtypes(df: DataFrame) -> DataFrame:
    """One row per column: position, Spark type, total rows and columns."""
    n_rows = df.count()
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    spark = df.sparkSession
    return spark.createDataFrame(rows, "position int, column_name string, dtype string") \
        .withColumn("n_rows", F.lit(n_rows).cast("long")) \
        .withColumn("n_cols", F.lit(len(df.columns)).cast("int"))


# Pages shallower than this use a top-N (each task keeps N rows); deeper pages
# use a distributed rank so no task or driver ever holds offset+size rows.
SHALLOW_PAGE_ROWS = 100_000


def page(df: DataFrame, key: Sequence[str] | str, page_no: int = 1, size: int = 50) -> DataFrame:
    """Rows ``(page-1)·size+1 … page·size`` in ``key`` order, with
    ``total_rows`` and ``total_pages``.  ``1 ≤ size ≤ 1000``."""
    if not 1 <= size <= 1000:
        raise ValueError("page size must be within 1..1000")
    if page_no < 1:
        raise ValueError("page must be ≥ 1")
    keys = [key] if isinstance(key, str) else list(key)
    total = df.count()
    offset = (page_no - 1) * size
    if offset + size <= SHALLOW_PAGE_ROWS:
        body = df.orderBy(*keys).limit(offset + size).offset(offset)
    else:
        r = ranked(df, keys, with_group_size=False)
        body = r.where((F.col(RANK) > offset) & (F.col(RANK) <= offset + size)).drop(RANK)
    return (body.withColumn("total_rows", F.lit(total).cast("long"))
                .withColumn("total_pages", F.lit((total + size - 1) // size).cast("long")))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       digits: int = 4) -> DataFrame:
    """Pearson r for every ordered pair (pairwise complete); NaN/±inf → 0."""
    cols = list(cols) if cols else numeric_cols(df)
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    r = F.col("r")
    clean = F.round(F.when(r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(r), digits)
    names = F.array(*[F.lit(c) for c in cols])
    upper = pair_correlations(df, [F.col(c) for c in cols]).select(
        F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), clean.alias("r"))
    both = F.when(F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b", "r"))).otherwise(
        F.array(F.struct("col_a", "col_b", "r"),
                F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")))
    return upper.select(F.inline(both))


def _logical_type(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.BooleanType):
        return "numeric"
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, NUMERIC):
        return "numeric"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return None  # decided from the data
    return "unknown"


def infer_types(df: DataFrame, digits: int = 4, with_samples: bool = True) -> DataFrame:
    """Per column: storage type, logical type, missing count / %, distinct count
    and (optionally) the 5 smallest distinct values as text.

    Strings: every non-null value parses as a timestamp → ``datetime``;
    distinct/rows < 0.5 → ``categorical``; else ``text``.
    """
    n = F.count(F.lit(1))
    structs = []
    for f in df.schema.fields:
        c = F.col(f.name)
        lt = _logical_type(f.dataType)
        if lt is None:
            parsed = F.count(F.try_to_timestamp(c))
            lt_expr = (F.when((F.count(c) > 0) & (parsed == F.count(c)), "datetime")
                        .when(F.try_divide(F.count_distinct(c), n) < 0.5, "categorical")
                        .otherwise("text"))
        else:
            lt_expr = F.lit(lt)
        miss = (n - F.count(c))
        structs.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("storage_type"),
            lt_expr.alias("logical_type"),
            miss.alias("missing_count"),
            F.round(F.try_divide(miss, n) * 100.0, digits).alias("missing_pct"),
            F.count_distinct(c).alias("unique_count")))
    out = _structs_agg(df, structs)
    if not with_samples:
        return out
    cols = df.columns
    lv = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 (to_double(c) if isinstance(df.schema[c].dataType, NUMERIC)
                  else F.lit(None).cast("double")).alias("num"),
                 F.col(c).cast("string").alias("txt")) for c in cols])))
    distinct = lv.where(F.col("txt").isNotNull()).groupBy("column_name", "num", "txt").agg()
    # a filtered row number: every task keeps its own first five before the shuffle
    first5 = distinct.withColumn(RANK, F.row_number().over(
        Window.partitionBy("column_name").orderBy("num", "txt"))).where(F.col(RANK) <= 5)
    samples = first5.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(RANK, "txt"))),
                    lambda s: s["txt"]).alias("sample_values"))
    return join_small(out, samples, on="column_name", how="left", known_rows=len(cols))


def distribution_histogram(df: DataFrame, cols: Sequence[str] | None = None,
                           bins: int = 10, digits: int = 4) -> DataFrame:
    """Equal-width bins between min and max per column (max falls in the last
    bin); all ``bins`` rows per column, empty bins with count 0."""
    cols = list(cols) if cols else numeric_cols(df)
    bounds = _structs_agg(df, [F.struct(F.lit(c).alias("column_name"),
                                        F.min(F.col(c).cast("double")).alias("lo"),
                                        F.max(F.col(c).cast("double")).alias("hi"))
                               for c in cols])
    lv = long_values(df, cols).where(F.col("value").isNotNull())
    lv = join_small(lv, bounds, on="column_name", known_rows=len(cols))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width * bins).cast("int") + 1,
                F.lit(bins)))
    counts = lv.groupBy("column_name", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select("column_name", "lo", "hi",
                         F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = join_small(grid, counts, on=["column_name", "bin"], how="left",
                     known_rows=len(cols) * bins)
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select("column_name", "bin",
                      F.round(F.col("lo") + (F.col("bin") - 1) * w, digits).alias("lower"),
                      F.round(F.col("lo") + F.col("bin") * w, digits).alias("upper"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct rows, duplicates = rows − distinct rows.

    ``distinct`` aggregates map-side first, so a value repeated a billion times
    is collapsed before the shuffle.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k")).agg(
        F.coalesce(F.sum("_k"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")) \
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
