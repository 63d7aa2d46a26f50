"""Joins against sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes we are willing to ship to every executor.  A lookup side above it falls
# back to a shuffle join (sort-merge; AQE may still convert it at runtime).
MAX_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame):
    """Bytes of a row: its JSON text, an upper estimate of its binary form."""
    return F.length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = MAX_BROADCAST_BYTES, known_rows: int | None = None) -> DataFrame:
    """Join ``big`` with a side expected to be small.

    ``known_rows`` is an upper bound proven by construction (e.g. one row per
    bucket) for sides of numbers: 64 bytes a row are allowed for.  Without it the
    side's bytes are added up first, on the small side only.
    """
    if known_rows is not None:
        size = known_rows * 64
    else:
        size = small.agg(F.sum(_row_bytes(small))).first()[0] or 0
    if size <= max_bytes:
        return big.join(F.broadcast(small), on=on, how=how)
    return big.join(small, on=on, how=how)
