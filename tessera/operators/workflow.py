"""The whole preparation of a table from one configuration.

impute → scale → encode → select features → split → balance the training rows, each
step the operator of that name.  ``fit_on="all"`` fits statistics on every row before
the split; ``fit_on="train"`` splits first and fits on the training rows only, so
nothing of the test rows leaks into them.  Every step is logged with its outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_cols, string_cols
from .balance import balance, class_counts
from .encode import fit_encode
from .impute import fit_impute
from .scale import fit_scale
from .select import select_features
from .split import SPLIT, split_random, split_sequential, split_stratified


@dataclass
class Prepared:
    data: DataFrame                      # key, features, target and the column "split"
    features: list[str]
    target: str | None
    problem: str | None
    steps: list[str] = field(default_factory=list)
    scaling: str = "none"
    selection: DataFrame | None = None
    classes_before: dict = field(default_factory=dict)
    classes_after: dict = field(default_factory=dict)
    balanced: DataFrame | None = None    # the training rows after balancing

    @property
    def train(self) -> DataFrame:
        return self.balanced if self.balanced is not None else \
            self.data.where(F.col(SPLIT) == "train").drop(SPLIT)

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col(SPLIT) == "test").drop(SPLIT)

    def sizes(self) -> dict:
        return {"n_train": self.train.count(), "n_test": self.test.count(),
                "n_features": len(self.features)}


def _split(df: DataFrame, key, target, problem, test_size, seed, order) -> tuple[DataFrame, str]:
    if target and problem == "Classification":
        counts = class_counts(df, target)
        if len(counts) > 1 and min(counts.values()) >= 2:
            return split_stratified(df, key, target, test_size, seed), "stratified"
        return split_random(df, key, test_size, seed), "random"
    if target and problem == "Regression":
        return split_random(df, key, test_size, seed), "random"
    return split_sequential(df, list(order or [key]), test_size), "sequential"


def run_pipeline(df: DataFrame, key: str, target: str | None = None, problem: str | None = None,
                 numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
                 imputation: str = "auto", scaling: str = "auto", encoding: bool = True,
                 selection: dict | None = None, test_size: float = 0.2, seed: int = 42,
                 balancing: dict | None = None, order: Sequence[str] | None = None,
                 fit_on: str = "all") -> Prepared:
    """``key`` names each row; ``order`` (default the key) is the order of a sequential
    split, used without a classification or regression target.  ``selection`` holds
    ``method``, ``max_features``, ``threshold``; ``balancing`` ``method``, ``strategy``."""
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    aside = {key, target, *(order or [])}
    num = [c for c in (numeric if numeric is not None else numeric_cols(df)) if c not in aside]
    cat = [c for c in (categorical if categorical is not None else string_cols(df)) if c not in aside]
    out = Prepared(df, [], target, problem)
    rows = df
    if fit_on == "train":
        rows, how = _split(rows, key, target, problem, test_size, seed, order)
    seen = lambda d: d.where(F.col(SPLIT) == "train") if fit_on == "train" else d

    rows = fit_impute(seen(rows), num, cat, imputation).apply(rows)
    out.steps.append(f"imputation={imputation}")
    spec = fit_scale(seen(rows), num, scaling)
    rows, out.scaling = spec.apply(rows), spec.method
    out.steps.append(f"scaling={spec.method}")
    features = list(num)
    if encoding and cat:
        coder = fit_encode(seen(rows), cat)
        rows = coder.apply(rows)
        features += coder.output_columns()
        out.steps.append(f"encoding={len(coder.output_columns())} new cols")
    if selection and selection.get("method", "none") != "none":
        features, out.selection = select_features(
            seen(rows), features, target, selection["method"], selection.get("max_features", 10),
            selection.get("threshold", 0.05))
        out.steps.append(f"feature_selection={selection['method']} ({len(features)} features)")
    keep = [c for c in dict.fromkeys([key, *(order or []), target]) if c and c not in features]
    rows = rows.select(*keep, *features, *([SPLIT] if fit_on == "train" else []))
    if fit_on == "all":
        rows, how = _split(rows, key, target, problem, test_size, seed, order)
    out.steps.append(f"split={1 - test_size:.2f}/{test_size:.2f} {how}")
    out.data, out.features = rows, features
    method = (balancing or {}).get("method", "none")
    if target and method != "none":
        train = out.train
        out.classes_before = class_counts(train, target)
        out.balanced = balance(train, target, key, method, balancing.get("strategy", "auto"), seed, features)
        out.classes_after = class_counts(out.balanced, target)
        out.steps.append(f"imbalance_handling={method}")
    return out
