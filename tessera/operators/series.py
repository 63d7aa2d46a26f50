"""Time series in grouped form: ``(series keys..., order, value)``.

Simple forecasts (naive, mean, drift, linear, moving average), profiles,
regularisation and rolling bounds are Spark aggregates / windows whose
partitions are bounded (ranks come from the skew-safe range rank; rolling
windows run in fixed-size rank buckets with a halo of ``window − 1`` rows).
Statistical fits (ARIMA, SARIMA, trend + seasonality, ADF) are normal equations
summed over blocks of rows (``series_fit``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordering import GROUP_N, RANK, ranked
from .series_fit import adf_test, forecast_arma, forecast_trend  # noqa: F401


def detect_date_column(df: DataFrame, sample: int = 20) -> str | None:
    """First string column whose values all parse as timestamps (checked on the
    whole column in one aggregate; the catalogue rule looks at 20 values)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return None
    row = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
                 *[F.count(F.try_to_timestamp(F.col(c))).alias(f"p_{i}")
                   for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        if row[f"n_{i}"] and row[f"n_{i}"] == row[f"p_{i}"]:
            return c
    return None


def series_profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample std, min, max of the non-null values per series."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                               F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                               F.max(v).alias("max"))


def default_target(df: DataFrame, cols: Sequence[str]) -> str:
    """Numeric column of greatest (sample) variance."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return max(cols, key=lambda c: (row[c] if row[c] is not None else -1.0))


def indexed(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null values with ``_i`` (0-based position in order) and ``_n``."""
    d = df.where(F.col(value).isNotNull())
    r = ranked(d, list(order), by=list(by))
    return r.withColumn("_i", F.col(RANK) - 1).withColumnRenamed(GROUP_N, "_n").drop(RANK)


def forecast_simple(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
                    horizon: int = 10, method: str = "naive") -> DataFrame:
    """``(by..., step, forecast)`` for step 1..h.

    naive/simple: last value; mean: mean; moving_avg: mean of the last
    min(5, n); linear: least-squares line on the row index at n … n+h−1;
    drift: the same line at n+1 … n+h.  A series with n < h + 2 returns one row
    with ``status`` ``too_short`` and nulls; the others ``ok``.
    """
    by = list(by)
    v = F.col(value).cast("double")
    idx = indexed(df, order, value, by)
    stats = idx.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        F.max_by(v, F.col("_i")).alias("_last"),
        F.avg(v).alias("_mean"),
        F.avg(F.when(F.col("_i") >= F.col("_n") - F.least(F.col("_n"), F.lit(5)), v))
         .alias("_ma"),
        F.regr_slope(v, F.col("_i").cast("double")).alias("_slope"),
        F.regr_intercept(v, F.col("_i").cast("double")).alias("_icpt"))
    enough = F.col("_n") >= horizon + 2
    steps = F.when(enough, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(None).cast("int")))
    out = stats.select(*by, "_n", "_last", "_mean", "_ma", "_slope", "_icpt", F.explode(steps).alias("step"))
    x = F.col("_n").cast("double") + F.col("step")
    f = {"naive": F.col("_last"), "simple": F.col("_last"), "mean": F.col("_mean"),
         "moving_avg": F.col("_ma"),
         "linear": F.col("_icpt") + F.col("_slope") * (x - 1),
         "drift": F.col("_icpt") + F.col("_slope") * x}[method]
    short = F.col("step").isNull()
    return out.select(*by, "step", F.when(~short, f).alias("forecast"),
                      F.when(short, "too_short").otherwise("ok").alias("status"))


def rolling_bounds(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
                   window: int = 7, k: float = 2.0, bucket: int = 100_000) -> DataFrame:
    """Rolling mean ± k·(sample) std over the last ``window`` rows; null until a
    full window exists.  Adds ``roll_mean``, ``lower``, ``upper``, ``outside``.

    Rows are bucketed by rank into blocks of ``bucket`` (at least two windows); each block also gets
    the last ``window − 1`` rows of the previous block (halo), so every window
    partition is bounded regardless of series size.
    """
    by = list(by)
    bucket = max(bucket, 2 * window)
    idx = indexed(df, order, value, by)
    b = (F.col("_i") / bucket).cast("long")
    main = idx.withColumn("_b", b).withColumn("_halo", F.lit(False))
    halo = idx.where((F.col("_i") % bucket) >= bucket - (window - 1)) \
        .withColumn("_b", b + 1).withColumn("_halo", F.lit(True))
    both = main.unionByName(halo)
    w = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(-(window - 1), 0)
    v = F.col(value).cast("double")
    out = both.select("*", F.avg(v).over(w).alias("_m"), F.stddev_samp(v).over(w).alias("_s")) \
        .where(~F.col("_halo"))
    full = F.col("_i") >= window - 1
    m = F.when(full, F.col("_m"))
    s = F.when(full, F.col("_s"))
    res = out.select(*df.columns, m.alias("roll_mean"), (m - k * s).alias("lower"),
                     (m + k * s).alias("upper"))
    return res.withColumn("outside", (v < F.col("lower")) | (v > F.col("upper")))


_FREQ = {"D": ("day", "1 day"), "W": ("week", "1 week"), "M": ("month", "1 month"),
         "Q": ("quarter", "3 months"), "Y": ("year", "1 year")}


def regularize(df: DataFrame, date: str, values: Sequence[str], by: Sequence[str] = (),
               freq: str = "D", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Parse ``date``, put rows on a regular grid (period start at ``freq``),
    keep the last observation of each period, add the missing periods between
    each series' first and last period, then forward- and backward-fill."""
    by = list(by)
    values = list(values)
    unit, step = _FREQ[freq.upper()]
    ts = F.col(date) if not isinstance(df.schema[date].dataType, T.StringType) \
        else F.try_to_timestamp(F.col(date))
    d = df.select(*by, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("_p"),
                  F.struct(ts.alias("_t"), *[F.col(t) for t in tiebreak]).alias("_t"),
                  *values).where(F.col("_p").isNotNull())
    last = d.groupBy(*by, "_p").agg(*[F.max_by(F.col(v), F.col("_t")).alias(v) for v in values])
    # a series has at most one row a period here, however many rows it has in the table; each
    # stands for the periods up to the next, so the grid is filled as it is made
    w = Window.partitionBy(*by).orderBy("_p")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    # a series without a name has periods, but no values
    named = [F.col(c).isNotNull() for c in by]
    fill = lambda v: F.coalesce(F.last(v, ignorenulls=True).over(past), F.first(v, ignorenulls=True).over(ahead))
    filled = last.select(*by, "_p", F.lead("_p").over(w).alias("_to"), *[
        F.when(reduce(and_, named), fill(v)).alias(v) if by else fill(v).alias(v) for v in values])
    grid = F.sequence("_p", F.coalesce(F.col("_to") - F.expr(f"INTERVAL {step}"), F.col("_p")), F.expr(f"INTERVAL {step}"))
    return filled.select(*by, F.explode(grid).alias(date), *values)


def forecast(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = (),
             horizon: int = 10, method: str = "naive") -> DataFrame:
    """``(by..., step, forecast, ..., status)`` for every series and any horizon; a
    series too short for the method has one row with ``status`` ``too_short``."""
    horizon = int(horizon)
    if method in ("naive", "simple", "mean", "moving_avg", "linear", "drift"):
        return forecast_simple(df, order, value, by, horizon, method)
    if method in ("arima", "sarima"):
        return forecast_arma(df, order, value, by, horizon, 12 if method == "sarima" else 0)
    if method == "prophet":
        return forecast_trend(df, order, value, by, horizon)
    if method in ("lag_model", "lstm"):
        from .lag_model import forecast_lag_model
        return forecast_lag_model(df, order, value, by, horizon)
    raise ValueError(f"unknown forecast method {method}")
