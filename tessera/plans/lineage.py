"""Cutting lineage in iterative jobs.

Iterative operators (connected components, spanning forests, layouts) grow a
plan each round.  We cut it with a *reliable* checkpoint written to the shared
folder the cluster names in ``spark.checkpoint.dir`` so that a lost executor
does not force a replay of every earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
