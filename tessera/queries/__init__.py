"""Named queries over the driver tables: each is a Spark DataFrame builder
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, an equivalent
DuckDB statement used as the independent oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    from . import profile_q, columns_q, prep_q, evaluate_q, anomaly_q, series_q, advise_q  # noqa: F401
    from . import ml_q, sources_q, workflow_q  # noqa: F401
    return QUERIES, ORACLE
