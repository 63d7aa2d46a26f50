import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def make_texts(n=60, seed=1):
    """Texts with copies, near copies, shared passages, odd spaces and long words."""
    r = random.Random(seed)
    lexicon = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(lexicon) for _ in range(r.randint(1, 90))) for _ in range(n)]
    passage = " ".join(r.choice(lexicon) for _ in range(30))
    out = []
    for i, t in enumerate(base):
        if i % 6 == 1:
            t = base[i - 1]
        elif i % 6 == 2:
            w = base[i - 2].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif i % 6 == 3:
            t = t + " \n" + passage + "\t " + t[:40]
        elif i % 6 == 4:
            t = t.upper().replace(" ", " \x0b", 3)
        out.append(t)
    return out


EDGE = [None, "", " \n\t ", "one", "x" * 5000, "a b c d e " * 400, "ÀÉ î　ô \U0001F600 z"]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, repeated ids and rows, and columns whose
    names the operators use inside."""
    texts = make_texts() + EDGE
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "é", None)[i % 4], len(t or ""), "x", 1, "y")
            for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (3, "another text under an old id " * 3, "en", "a", 1, "x", 1, "y"),
             (None, texts[2], "en", "b", 2, "x", 1, "y"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id string, block int, key string").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
