"""Structured Streaming: the same operators on unbounded input.

Fitted ``PipelineModel``s and column expressions are plain transformations,
so they apply unchanged to a ``readStream`` source; results go to any sink
(``foreachBatch`` for exactly-once table writes).  State lives in the
checkpoint folder under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources import files


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream (new files are new micro-batches).  A single
    file is streamed as its folder filtered to that file name."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if files.is_file(spark, path):
        path, name = path.rstrip("/").rsplit("/", 1)
        r = r.option("pathGlobFilter", name)
    return r.parquet(path)


def score_stream(model, stream: DataFrame) -> DataFrame:
    """Apply a fitted model (or any transformer) to a streaming DataFrame."""
    return model.transform(stream)


def run_to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Drain every available micro-batch into a Parquet table in the shared folder
    (or at ``path``) and return it as a batch DataFrame.  A rerun with the same path
    goes on where the last one stopped."""
    spark = stream.sparkSession
    path = path or files.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", files.join(path, "progress")).option("path", files.join(path, "rows"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(files.join(path, "rows"))
