from collections import Counter

from tessera.llm.substring import NULL_ID, FMIndex, dedup

import numpy as np
from .conftest import words


def brute(rows):
    seen = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p:p + 13])
            seen[g] = min(seen.get(g, NULL_ID), NULL_ID if i is None else i)
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if seen[tuple(w[p:p + 13])] < (NULL_ID if i is None else i):
                gone.update(range(p, p + 13))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(docs).collect())
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 300


def test_removed_runs_name_the_words(docs):
    for r in dedup(docs).collect():
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed


def test_empty_table(none):
    assert dedup(none).count() == 0


def test_index_finds_all_patterns():
    r = np.random.default_rng(0)
    seq = np.append(r.integers(1, 5, 400), 0).astype(np.int32)
    index = FMIndex(seq, 5)
    start = np.arange(0, 380)
    for length in (1, 3, 8):
        lo, hi = index.search(seq, start, length)
        for s, a, b in zip(start, lo, hi):
            n = sum((seq[k:k + length] == seq[s:s + length]).all() for k in range(401 - length))
            assert b - a == n or (b - a == 1 and n == 1)


def test_hot_minimizers_are_dealt_by_window(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for hot in (0, 3):
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(docs, hot=hot).collect()) == brute(rows)


def test_a_hot_passage_is_sent_once_a_block():
    import pyarrow as pa
    from tessera.llm import substring as S
    ids = list(range(300, 0, -1))
    for words_, hot in ((40, S.HOT), (13, 100)):  # with its surroundings equal, and not
        passage = " ".join(f"p{k}" for k in range(words_))
        around = (lambda i: "x") if words_ == 40 else (lambda i: f"a{i} b{i} c{i}")
        texts = [f"{around(i)} {passage} {around(-i)}" for i in range(300)]
        block = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts), "mark": pa.array(range(300), pa.int64()),
                          "block": pa.array([0] * 300, pa.int32())})
        shards = 8
        told = S._tell(shards)(block)
        answers = [S._answer(told.slice(k, 1), hot) for k in range(told.num_rows)]
        sent = S._send(shards)(block, pa.concat_tables(answers))
        n = [len(x.as_py()) for x in sent.column("length")]
        assert sum(n) < 20 if words_ == 40 else max(n) < 0.5 * sum(n)
        spans = pa.concat_tables([S._match(sent.slice(k, 1)) for k in range(sent.num_rows)])
        got = S._cut(block, spans)
        want = brute(list(zip(ids, texts)))
        assert Counter(zip(*(got.column(c).to_pylist() for c in ("id", "n_words", "n_removed", "kept")))) == want
        assert sum(got.column("n_removed").to_pylist()) >= 299 * 13


def test_a_hot_window_alone_and_inside_longer_segments():
    """The first text is a single window; the same window stands inside others' segments."""
    import pyarrow as pa
    from tessera.llm import substring as S
    words_ = [f"p{k}" for k in range(13)]
    texts = [" ".join(words_)] + [" ".join([f"a{i}", f"b{i}", *words_, f"c{i}", f"d{i}"]) for i in range(40)]
    block = pa.table({"id": pa.array(range(41), pa.int64()), "text": pa.array(texts), "mark": pa.array(range(41), pa.int64()),
                      "block": pa.array([0] * 41, pa.int32())})
    told = S._tell(1)(block)
    got = S._cut(block, S._match(S._send(1)(block, S._answer(told, 0))))
    assert Counter(zip(*(got.column(c).to_pylist() for c in ("id", "n_words", "n_removed", "kept")))) == brute(list(enumerate(texts)))
