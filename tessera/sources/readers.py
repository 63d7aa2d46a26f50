"""Readers and writers for datasets.

Extension dispatch follows the catalog rules: ``csv``, ``tsv``, ``json``,
``parquet``; an unknown extension (e.g. ``.txt``) is tried as CSV.  Spark reads
a directory of part files the same way it reads one file, so these scale to
any number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    r = (spark.read.option("header", True).option("sep", sep)
         .option("mode", "PERMISSIVE"))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return read_csv(spark, path, sep="\t", schema=schema)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array of objects (read multi-line) or JSON lines (split by line,
    so a large file is read in parallel).  The form is decided by the first
    non-blank character of the input."""
    head = spark.read.text(path).where(F.trim("value") != "").select(
        F.substring(F.trim("value"), 1, 1).alias("c")).first()
    multiline = head is not None and head["c"] == "["
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_READERS = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet,
            "pq": read_parquet}


def _extension(name: str) -> str:
    tail = name.rstrip("/").rsplit("/", 1)[-1]
    return tail.rsplit(".", 1)[1].lower() if "." in tail.lstrip(".") else ""


def detect_format(spark: SparkSession, path: str) -> str:
    """The extension of the path, or of the first file in a folder without one."""
    found = _extension(path)
    if not found:
        inside = [n for n in files.names(spark, path) if not n.startswith((".", "_"))]
        found = _extension(inside[0]) if inside else ""
    return found


def read_any(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Dispatch on ``format`` or the lower-cased extension; unknown → CSV."""
    fmt = (format or detect_format(spark, path)).lower()
    reader = _READERS.get(fmt)
    if reader is not None:
        return reader(spark, path)
    try:
        return read_csv(spark, path)
    except Exception as exc:  # noqa: BLE001 - reported as a clear error
        raise ValueError(f"unsupported file format '{fmt}' for {path}: {exc}") from exc


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN → NULL on floating columns (one missing-value notion downstream)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType))
                         .otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
