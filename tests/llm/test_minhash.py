import numpy as np
import pyarrow as pa

from tessera.llm.minhash import near_duplicates, shingle_sets, signatures

from .conftest import LOWER, words


def shingles(t):
    w = words((t or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i is None, i or 0, len(s), i is not None and find(i)) for i, s in rows)


def check(df, rows):
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.doc_id is not None and r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_against_brute_force(docs):
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_near_copies_that_miss_the_centre(spark):
    """Each text replaces a little more of the first: neighbours link, the ends do not."""
    base = [f"t{i}" for i in range(200)]
    rows = [(100 - k, " ".join([f"n{k}_{j}" if j // 2 < k else w for j, w in enumerate(base)])) for k in range(40)]
    rows += [(200 + k, " ".join(base[:100] + [f"m{k}_{j}" for j in range(20)])) for k in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty_table(none):
    assert near_duplicates(none).count() == 0


def test_circulant_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a = [f"a{i}" for i in range(600)]
    b = a[:450] + [f"b{i}" for i in range(150)]
    value, first = shingle_sets(pa.array([" ".join(a), " ".join(b)]))
    x, y = set(value[:first[1]].tolist()), set(value[first[1]:].tolist())
    sig = signatures(value, first, 2000)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05
    assert len(np.unique(sig[0])) > 500

