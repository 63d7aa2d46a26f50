"""A corpus pipeline of five stages, each on all that its predecessor kept.

``run(spark, sf_dir)`` applies them to ``documents``; every stage's result is
written as Parquet into the shared folder of ``spark.checkpoint.dir`` and read
again.  All stages but the last return the columns of ``documents``; the last
returns one row for each repetition of a document in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, mixing, pii, toxicity
from tessera.llm.common import store, table


#: Tokens of a benchmark item that must stand in a document for the document to go: a
#: shorter item ("yes") is no evidence of where a text is from.
LEAST_TOKENS = 8


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, written once so that every reader sees the same, and
    the number's column.  Ids may be null or repeat; decisions refer to the number."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return store(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go.  The classifier
    learns from the labelled rows of ``docs`` that are not held out.  A null text is scored
    as an empty one; a row with a null id has no label, and is scored like any other."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_score", reject_col="_rejected") \
        .where(~F.col("_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id (null ids
    last; among equal ids one chosen by its content).  Rows count, not ids: unlike texts
    under one id both stay.  Documents without words are like no other, so all stay."""
    rows, number = _numbered(docs)
    found = minhash.near_duplicates(rows, id_col=number).select(number, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), number)
    one = rows.select(number, order.alias("order")).join(found, number) \
        .groupBy("component_id").agg(F.min_by(number, "order").alias(number))
    return rows.join(one.select(number), number, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of ``LEAST_TOKENS`` tokens or more, or that many
    tokens of one, go, whatever their id; null and empty texts stay."""
    rows, number = _numbered(docs)
    found = decontaminate.overlaps(rows, table(spark, sf_dir, "benchmark"), id_col=number).where(F.col("length") >= LEAST_TOKENS)
    return rows.join(found.select(number).distinct(), number, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; ``n_chars`` follows the text."""
    return pii.mask(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per repetition of a document in the mix: the columns of ``documents``,
    ``repetition`` (from 0) and ``words`` that it takes.  The repetition that meets a
    source's target in part holds its first words only."""
    return mixing.repeated(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the MinHash candidates and the field have no SQL form.
ORACLE_SQL = None
