import random

from tessera.llm.decontaminate import LEAST, overlaps


def build(spark):
    r = random.Random(3)
    lexicon = [f"v{i}" for i in range(3000)]
    items = [[r.choice(lexicon) for _ in range(n)] for n in (15, 30, 59, 20, 13, 8, 3)]
    filler = lambda n: [r.choice(lexicon) for _ in range(n)]
    docs, want = [], set()
    for k, item in enumerate(items[:5]):
        docs.append((10 * k, " ".join(filler(40) + item + filler(9))))  # whole
        docs.append((10 * k + 1, " ".join(filler(5) + [w.upper() + "," for w in item])))  # case and punctuation
        want |= {(10 * k, k), (10 * k + 1, k)}
        if len(item) >= 15:
            edges = [("sub" if j in (1, len(item) - 2, len(item) // 2) else w) for j, w in enumerate(item)]
            docs.append((10 * k + 6, " ".join(filler(20) + edges + filler(20))))  # substitutions at the edges
            want |= {(10 * k + 6, k)}
        if len(item) >= 20:
            changed = [("sub" if j % 7 == 3 else w) for j, w in enumerate(item)]
            docs.append((10 * k + 2, " ".join(filler(20) + changed + filler(20))))  # substitutions
            docs.append((10 * k + 3, " ".join(filler(20) + item[3:3 + LEAST + 1] + filler(20))))  # a part
            want |= {(10 * k + 2, k), (10 * k + 3, k)}
        docs.append((10 * k + 4, " ".join(filler(20) + item[:7] + filler(20))))  # too little
        docs.append((10 * k + 5, " ".join(sorted(item))))  # the words alone
    docs.append((200, " ".join(items[0] + filler(30) + items[1] + items[0])))
    docs.append((201, " ".join(items[5])))
    want |= {(200, 0), (200, 1), (201, 5)}
    docs += [(300, None), (301, ""), (302, " ".join(filler(20000))), docs[0]]
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, item_id int, item int, tokens string")
    b = spark.createDataFrame([(k, " ".join(t), 0) for k, t in enumerate(items)] + [(90, None, 0), (91, "", 0), (0, " ".join(items[0]), 0)],
                              "item_id long, text string, doc_id int")
    return d, b, want


def test_finds_passages_and_leaves_clean_texts(spark):
    d, b, want = build(spark)
    got = overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    whole = next(r for r in got if (r.doc_id, r.item_id) == (0, 0))
    assert (whole.doc_start, whole.item_start, whole.length, whole.matches) == (40, 0, 15, 15)


def test_empty_tables(spark):
    d, b, _ = build(spark)
    assert overlaps(d.where("false"), b).count() == 0
    assert overlaps(d, b.where("false")).count() == 0


def test_items_shorter_than_a_seed(spark):
    from tessera.llm import decontaminate
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 7)] + [(9, "")]
    rows = [(n, f"some words {t.upper()}, then others; {t} again") for n, t in items]
    rows += [(100, "q5x0 q5x1 q5x2 q5x3 other q5x4 q2x1 q2x0"), (101, "q3x0 q3x1"), (102, "q3x2"), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.length, r.matches) for r in got) == \
        [(n, n, 2, 0, n, n) for n in range(1, 7)]
