"""Categorical encoding and feature construction.

``fit_encode`` runs one distributed ``groupBy(column, value).count`` over all
categorical columns; columns with ≤ ``max_onehot`` distinct values collect
their (bounded) category lists and become one-hot expressions; wider columns
keep their frequency table as a DataFrame that is joined back (broadcast only
after its size is checked).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_cols, string_cols
from ..plans.joins import join_small
from ..plans.ordering import RANK, long_values, quantile_table, ranked

MAX_ONEHOT = 20


@dataclass
class EncodeSpec:
    onehot: dict = field(default_factory=dict)      # column -> sorted categories (first dropped)
    freq: dict = field(default_factory=dict)        # column -> DataFrame(value, freq)
    order: list = field(default_factory=list)

    def output_columns(self) -> list[str]:
        out = []
        for c in self.order:
            if c in self.onehot:
                out += [f"{c}_{v}" for v in self.onehot[c][1:]]
            else:
                out.append(f"{c}_freq")
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        for c, table in self.freq.items():
            t = table.select(F.col("value").alias(c), F.col("freq").alias(f"{c}_freq"))
            out = join_small(out, t, on=c, how="left")
        keep = [F.col(x) for x in df.columns if x not in self.onehot and x not in self.freq]
        new = []
        for c in self.order:
            if c in self.onehot:
                for v in self.onehot[c][1:]:
                    new.append(F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}"))
            else:
                new.append(F.col(f"{c}_freq"))
        return out.select(*keep, *new)


def fit_encode(df: DataFrame, cols: Sequence[str] | None = None,
               max_onehot: int = MAX_ONEHOT) -> EncodeSpec:
    cols = list(cols) if cols is not None else string_cols(df)
    if not cols:
        return EncodeSpec()
    vc = (long_values(df, cols, value_type="string").where(F.col("value").isNotNull())
          .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))
    stats = {r["column_name"]: (r["n"], r["total"]) for r in
             vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("cnt").alias("total")).collect()}
    low = [c for c in cols if stats.get(c, (0, 0))[0] <= max_onehot]
    spec = EncodeSpec(order=cols)
    if low:
        cats: dict = {c: [] for c in low}
        for r in vc.where(F.col("column_name").isin(low)).select("column_name", "value").collect():
            cats[r["column_name"]].append(r["value"])
        spec.onehot = {c: sorted(v) for c, v in cats.items()}
    for c in cols:
        if c in spec.onehot:
            continue
        total = stats[c][1]
        spec.freq[c] = vc.where(F.col("column_name") == c).select(
            "value", (F.col("cnt") / F.lit(float(total))).alias("freq"))
    return spec


def encode(df: DataFrame, cols=None, apply_encoding: bool = True) -> DataFrame:
    if not apply_encoding:
        return df
    return fit_encode(df, cols).apply(df)


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Ordinal codes 0..k-1 in ascending value order (null stays null).

    Codes come from a distributed rank of the distinct values, so the category
    list never passes through the driver."""
    out = df
    for c in cols:
        d = df.select(F.col(c).alias("value")).where(F.col("value").isNotNull()).distinct()
        codes = ranked(d, ["value"], with_group_size=False).select(
            F.col("value").alias(c), (F.col(RANK) - 1).alias(f"{c}{suffix}"))
        out = join_small(out, codes, on=c, how="left")
    return out


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """Degree-2 products: squares ``a^2`` and cross terms ``a*b`` (i < j)."""
    if degree != 2:
        raise ValueError("only degree 2 is supported")
    cols = list(cols)
    extra = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            name = f"{a}^2" if a == b else f"{a}*{b}"
            extra.append((F.col(a).cast("double") * F.col(b).cast("double")).alias(name))
    return df.select("*", *extra)


def bin_features(df: DataFrame, cols: Sequence[str] | None = None, n_bins: int = 5,
                 suffix: str = "_bin") -> DataFrame:
    """Equal-frequency bins 0..n_bins-1 from exact interpolated quantile cuts:
    bin = number of interior cuts ≤ x (null stays null)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    probs = [i / n_bins for i in range(1, n_bins)]
    qt = quantile_table(df, cols, probs, "linear")
    extra = []
    for c in cols:
        cuts = [qt[c][round(p, 12)] for p in probs]
        x = F.col(c).cast("double")
        b = F.lit(0)
        for cut in cuts:
            b = b + F.when(x >= F.lit(cut), 1).otherwise(0)
        extra.append(F.when(x.isNull(), None).otherwise(b).alias(f"{c}{suffix}"))
    return df.select("*", *extra)
