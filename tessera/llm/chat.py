"""Chat formatting of reply trees.

A node replies to its parent.  Self-joins that double the distance (each node
learns its ancestor 1, 2, 4, ... steps up, with the sum of the scores between) find
every node's depth and path score in log2(depth) rounds; the same tables then list
the nodes of the chosen root-to-leaf paths, the largest step first, so a thread of
thousands of turns takes a dozen joins.  The paths of a tree are ranked by the sum
of their scores (then the smaller leaf), the best ``branches`` are formatted.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn.  In roles
and texts every backslash is doubled and every control string (of this template and
of other common ones) gets a backslash after its first character, so none remains
and ``unescape`` restores the text.  ``loss`` holds the code-point spans of the
assistant's texts in the formatted string.

Inputs and results: a null text, role or score is empty or 0; a null tree is a tree
of its own; a row without a node is left out; of rows that repeat a tree and node the
smallest by role and text stays; a parent that is null, the node itself or missing
makes a root; nodes on a cycle of replies, or under one, have no root and no path; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import table

#: Trees that are done leave the doubling once so small a share of the nodes is on its way.
SHRINK = 8
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that no formatted text may hold (fixed values).
CONTROL = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text):
    """Column: ``text`` (null: empty) without control strings, reversibly."""
    heads = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), f"({heads})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece.removeprefix(START).split(SEP, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``(tree, leaf, node, place, rank)`` of the best root-to-leaf paths of ``nodes
    (tree, node, parent, score)``, unique by tree and node; place counts from the root."""
    ids = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.where("parent is not null and parent <> node") \
        .join(ids, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("jump"))
    step = cut(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).cast("double").alias("gain"))
               .join(linked, ["tree", "node"], "left")
               .withColumn("hops", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long")))
    ups, ends = [], []

    def state(t):
        r = t.agg(F.count("*").alias("n"), F.count("jump").alias("left")).first()
        return r["n"], r["left"]

    total, left = state(step)
    while left:
        ups.append(step.where("jump is not null").select("tree", "node", "jump"))
        if left * SHRINK < total:  # go on with the trees that are not done
            trees = step.where("jump is not null").select("tree").distinct()
            ends.append(step.join(trees, "tree", "left_anti"))
            step = cut(step.join(trees, "tree", "left_semi"))
        going = step.where("jump is not null")
        on = step.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"),
                         F.col("gain").alias("more"), F.col("hops").alias("further"))
        step = cut(step.where("jump is null").unionByName(going.join(on, ["tree", "jump"], "left").select(
            "tree", "node", (F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("gain"),
            F.col("next").alias("jump"), (F.col("hops") + F.coalesce("further", F.lit(0))).alias("hops"))))
        before, (total, left) = left, state(step)
        if left == before:
            break  # what is left hangs on a cycle
    for done in ends:
        step = step.unionByName(done)
    leaves = step.where("jump is null").join(linked.select("tree", F.col("jump").alias("node")), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("gain").desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    out = cut(ranked.select("tree", F.col("node").alias("leaf"), "node", F.col("hops").alias("place"), "rank"))
    for k in range(len(ups) - 1, -1, -1):
        further = out.join(ups[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("jump").alias("node"), (F.col("place") - (1 << k)).alias("place"), "rank")
        out = cut(out.unionAll(further))
    return out


def conversations(nodes: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role",
                  text: str = "text", score: str | None = "score", branches: int | None = 1) -> DataFrame:
    """One row per chosen path: ``tree, leaf, rank, n_turns, formatted, loss`` (spans)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    rows = nodes.select(
        key.alias("tree"), F.col(tree).alias("origin"), F.col(node).cast("long").alias("node"),
        F.col(parent).cast("long").alias("parent"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        (F.col(score).cast("double") if score else F.lit(0.0)).alias("score")).where("node is not null")
    one = Window.partitionBy("tree", "node").orderBy("role", "text", "parent", "score")
    rows = cut(rows.withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy"))
    turns = paths(rows.select("tree", "node", "parent", "score"), branches) \
        .join(rows.select("tree", "origin", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    piece = turns.withColumn("head", head).withColumn("body", escape(F.col("text"))) \
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
    upto = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.sum(F.length("piece").cast("long")).over(upto) - F.length("piece") + F.length("head")
    placed = piece.withColumn("begin", begin).withColumn("span", F.when(
        F.col("role") == "assistant", F.struct(F.col("begin"), (F.col("begin") + F.length("body")).alias("end"))))
    got = placed.groupBy("tree", "leaf", "rank").agg(
        F.first("origin").alias("origin"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"),
        F.sort_array(F.collect_list("span")).alias("loss"))
    return got.select(F.col("origin").alias(tree), "leaf", "rank", "n_turns",
                      F.array_join(F.col("p.piece"), "").alias("formatted"), "loss")


def _digests(batches):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for f, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            turns = parse(f)
            said = "".join(unescape(f[s["begin"]:s["end"]]) for s in loss)
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(f)))
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of ``(conv_id, formatted, loss)``, taken from the formatted string alone."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _digests, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
                  "loss_chars long, loss_sha256 string, formatted_chars long")


def as_trees(rows: DataFrame) -> DataFrame:
    """Conversations ``(conv_id, turn, role, text)`` as trees of one branch: rows by
    turn, then role and text, each a reply to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node")) \
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def op6_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(conversations(as_trees(rows.unionAll(extra)), tree="conv_id"))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(role, '\', '\\'), '(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1+', 'g'))
  + length(regexp_replace(replace(text, '\', '\\'), '(<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1+', 'g')) + 32 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
