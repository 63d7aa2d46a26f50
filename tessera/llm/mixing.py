"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: every source gets a share of the budget by its weight, no
source more than ``epochs`` times its size; what is above is shared out again by
weight among the others until none is above.  A state of that process is one
number, the words per unit of weight, so each round is one aggregate over the
table of sources.

A source's target is then sampled as whole repetitions of all its documents and
a fractional one: documents in the order of a seeded hash are taken once more
until the target is met, the last of them in part (its first words).  So a
source's taken words are its target, rounded.  Hash prefixes split a source into
4096 buckets whose sums are added up first; only the bucket in which the target
falls is put in order.

Inputs and results: a null text has size 0; a null source is a source of its own
that ranks last; null and repeated ids are ordinary rows (equal rows share one
place in the order, so either may be the one taken); an empty table gives an
empty one; a table without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store, table

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hex digits of the hash that name a bucket; bytes of a table that may be broadcast.
PREFIX, BROADCAST_BYTES = 3, 16 << 20


def water_fill(sources: DataFrame, budget: float) -> float | None:
    """Words per unit of weight for ``sources (weight, cap)``; None: all at their cap."""
    level, capped = 0.0, -1
    while True:
        at = F.col("cap") < F.lit(level) * F.col("weight")
        r = sources.agg(F.count_if(at).alias("n"), F.sum(F.when(at, F.col("cap"))).alias("cap"),
                        F.sum(F.when(~at, F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            return None
        if r["n"] == capped:
            return level
        capped, level = r["n"], (budget - float(r["cap"] or 0)) / float(r["weight"])


def _columns(id_col: str, text: str, source: str, seed: str) -> list:
    """Key of the source (null: empty, and no other source is), words, place in the order."""
    return [F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h")]


def plan(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From rows ``(key, size, h)``: a row per source with its target, whole
    repetitions, the words left for the fractional one and the bucket it ends in."""
    # one row per source; null (the key "") ranks last
    order = Window.orderBy(F.col("key") == "", "key")
    every = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = store(every.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_fill(sources, share * total)
    target = F.col("cap").cast("double") if level is None else \
        F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    aims = sources.withColumn("target", target).withColumn(
        "whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))) \
        .withColumn("rest", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    sums = rows.groupBy("key", _bucket().alias("bucket")).agg(F.sum("size").alias("words"))
    upto = sums.withColumn("before", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words"))
    # the bucket in which the rest of the target ends (none: it takes all or nothing)
    edge = upto.join(aims.select("key", "rest"), "key").where("before <= rest and rest < before + words") \
        .select("key", F.col("bucket").alias("edge"), "before")
    return store(aims.select("key", "source_size", "target", "whole", "rest").join(edge, "key", "left"))


def _bucket():
    return F.substring("h", 1, PREFIX)


def taken(rows: DataFrame, aims: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (with ``key, size, h``) and ``source_size, target, taken``."""
    columns = rows.columns
    small = aims.agg(F.sum(F.length("key") + 80)).first()[0] or 0
    known = rows.join(F.broadcast(aims) if small <= BROADCAST_BYTES else aims, "key")
    here = F.coalesce(_bucket() == F.col("edge"), F.lit(False))
    all_ = (F.col("rest") > 0) & (F.col("edge").isNull() | (_bucket() < F.col("edge")))
    clear = known.where(~here).withColumn("extra", F.when(all_, F.col("size")).otherwise(0).cast("long"))
    upto_row = F.sum("size").over(Window.partitionBy("key").orderBy("h", id_col, "size")
                                  .rowsBetween(Window.unboundedPreceding, 0))
    split = known.where(here).withColumn("start", F.col("before") + upto_row - F.col("size")).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long")).drop("start")
    return clear.unionByName(split).withColumn(
        "taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long")) \
        .select(*columns, "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``id_col, source, size, source_size, target, taken`` for every row of ``docs``."""
    rows = store(docs.select(F.col(id_col).alias("id"), F.col(source).alias("origin"),
                             *_columns(id_col, text, source, seed)))
    return taken(rows, plan(rows, weights, share, epochs), "id").select(
        F.col("id").alias(id_col), F.col("origin").alias(source), "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs`` with a row per repetition, numbered from 0 in
    ``repetition``, and the ``words`` that it takes; one that is taken in part holds
    its first words, joined by one space.  Columns of ``docs`` of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("repetition", "words")]
    measured = docs.select(F.col(id_col).alias("id"), *_columns(id_col, text, source, seed),
                           F.struct(*columns).alias("row"))
    aims = plan(store(measured.select("key", "size", "h")), weights, share, epochs)
    each = taken(measured, aims, "id").where("taken > 0").withColumn("repetition", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("repetition") * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    whole = words == F.col("size")
    return each.select(*[F.when(whole, F.col("row")[c]).otherwise(part).alias(c) if c == text else F.col("row")[c].alias(c)
                         for c in columns], "repetition", words.alias("words"))


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
fill(step, level, capped) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT f.step + 1,
    (SELECT CASE WHEN sum(CASE WHEN NOT cap < f.level * weight THEN weight END) > 0
       THEN (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE
             - coalesce(sum(CASE WHEN cap < f.level * weight THEN cap END), 0)::DOUBLE)
            / sum(CASE WHEN NOT cap < f.level * weight THEN weight END)::DOUBLE END FROM s),
    (SELECT count(*) FILTER (WHERE cap < f.level * weight) FROM s)
  FROM fill f WHERE f.level IS NOT NULL
    AND (SELECT count(*) FILTER (WHERE cap < f.level * weight) FROM s) <> f.capped),
lv AS (SELECT level FROM fill ORDER BY step DESC LIMIT 1),
a AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target
  FROM s, lv),
b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM a),
c AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS rest FROM b),
e AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, c.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM e
"""
