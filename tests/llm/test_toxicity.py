import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    clean, bad = [f"word{i}" for i in range(500)], ["nasty", "vile", "grim"]
    out = []
    for i in range(900):
        w = [r.choice(clean) for _ in range(r.randint(5, 60))]
        y = int(r.random() < 0.3)
        for _ in range(2 * y):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "!", ","])
        out.append((i, " ".join(w), "en" if i % 2 else "de", y))
    return out


def test_learns_and_leaves_clean_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic").unionAll(spark.createDataFrame([(0, None), (None, 1), (1, 0)], "doc_id long, toxic int"))
    held = {r.doc_id for r in df.where(toxicity.held_out("doc_id")).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.train(df, labels)
    assert held and toxicity.train(df, turned) == model  # held-out labels are never read
    more = [(1000, None, None, 0), (1001, "", "xx", 0), (1002, "word1 " * 20000, "en", 0), (1003, "so NASTY\n", None, 1), (1003, "so NASTY\n", None, 1), (None, "word2", "de", 0)]
    all_ = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, toxic int").withColumnRenamed("toxic", "net")
    got = toxicity.score(all_, model).collect()
    assert len(got) == len(rows) + len(more)
    wrong = sum((r.score >= 0.5) != bool(r.net) for r in got if r.doc_id in held)
    assert wrong <= 0.02 * len(held) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1002].score < 0.5 and by[1003].score > 0.5 and not by[1001].rejected and by[1003].rejected
    assert by[1000].score == by[1001].score


def test_language_is_no_input(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df, df)
    a, b = (spark.createDataFrame([(1, "vile word3 word4", x)], "doc_id long, text string, lang string") for x in ("en", "de"))
    assert toxicity.score(a, model).first().score == toxicity.score(b, model).first().score


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "en", 0)], "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df, df)
    assert toxicity.score(df, model).first().rejected is False
    assert toxicity.score(df.where("false"), model).count() == 0
    assert toxicity.train(df, df.where("false")) == (None, 0.0)


def test_threshold_errs_least():
    import numpy as np
    s, y = np.linspace(0, 1, 200), (np.linspace(0, 1, 200) > 0.7).astype(int)
    assert abs(toxicity._threshold(s, y, np.ones(200)) - 0.7) < 0.01
