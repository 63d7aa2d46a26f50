import math
import zlib
from collections import Counter

import numpy as np

from tessera.llm import lm

from .conftest import LOWER, words


def test_base_score_and_counts(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    count = Counter()
    tokens = lambda t: words((t or "").translate(LOWER)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in rows:
        if not held(i):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i is None, i or 0, held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)),
                    round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for i, t in rows))
    got = lm.score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table(none):
    assert lm.score(none).count() == 0


def test_windows_score_each_token_once_with_context():
    first = np.concatenate([[0], np.cumsum([0, 5, 63, 64, 200, 1])])
    seen = Counter()
    for text, x, word, scored, end in lm.batches(first, np.arange(first[-1]), int(first[-1]), 2):
        for t, w, s, e in zip(text, word, scored, end):
            for k in np.flatnonzero(s):
                seen[t, int(w[k] - first[t])] += 1
                assert e[k] == (w[k] - first[t] == first[t + 1] - first[t])
                assert k >= lm.OVERLAP or w[k] - first[t] == k
    assert seen == {(t, p): 1 for t in range(6) for p in range(first[t + 1] - first[t] + 1)}


def test_attention_is_causal_and_a_distribution():
    model = lm.Model.fresh(np.zeros(lm.BUCKETS, np.int16))
    x = np.random.default_rng(0).normal(0, 1, (2, lm.CONTEXT, lm.WIDTH)).astype(np.float32)
    z, _ = model.forward(x, model.mask())
    assert np.allclose(np.exp(z).sum(-1), 1, atol=1e-4)
    x[:, 20:] = 9
    z2, _ = model.forward(x, model.mask())
    assert np.allclose(z[:, :20], z2[:, :20], atol=1e-5) and not np.allclose(z[:, 20:], z2[:, 20:])


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    model = lm.Model.fresh(np.zeros(lm.BUCKETS, np.int16))
    for k in model.PARTS:
        setattr(model, k, getattr(model, k).astype(np.float64))
    x = r.normal(0, 0.5, (2, lm.CONTEXT, lm.WIDTH))
    target = r.integers(0, lm.CLASSES, (2, lm.CONTEXT))
    weight = (r.random((2, lm.CONTEXT)) < 0.7).astype(float)
    _, g, _ = model.gradients(x, target, weight, model.mask().astype(np.float64))
    for key in ("q", "k", "v", "o", "out", "bias"):
        a = getattr(model, key)
        at = tuple(0 for _ in a.shape)
        a[at] += 1e-4
        up = model.gradients(x, target, weight, model.mask())[0]
        a[at] -= 2e-4
        down = model.gradients(x, target, weight, model.mask())[0]
        a[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[key][at]) < 1e-4 + 0.02 * abs(g[key][at]), key


def test_beats_base_on_held_out_texts(spark):
    """Two languages whose words never mix: what stands before tells the next class."""
    r = np.random.default_rng(4)
    words_of = [[f"{a}{b}" for a in ("the", "ing", "wh", "ou") for b in range(60)], [f"{a}{b}" for a in ("eux", "que", "oi", "les") for b in range(60)]]
    rows = [(i, " ".join(r.choice(words_of[i % 2], 80))) for i in range(300)]
    got = [x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert sum(x.score > x.base_score for x in got) > 0.9 * len(got) > 30


def test_classes_and_weights_learn_from_every_text(spark):
    """With first weights from few texts, all texts' contexts and all texts' training count."""
    r = np.random.default_rng(6)
    rows = [(" ".join(r.choice([f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in range(30)], 20)),) for i in range(200)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    want = Counter()
    for (t,) in rows:
        w = lm.Words.of(lm.pa.array([t]))
        b = lm.buckets_of(w, np.arange(len(w))).astype(int)
        want.update((b[i], b[j] % lm.DIMS) for i in range(len(b)) for j in range(max(0, i - 8), i))
    got = lm.all_contexts(docs)
    assert {k: got[k] for k in zip(*np.nonzero(got))} == want
    raw = lm.train(docs, sample=3)
    classes = lm.Model.from_bytes(raw).classes
    seen = classes[got.sum(1) > 0]
    assert (seen != 0).mean() > 0.5 and len(np.unique(seen)) > lm.CLASSES // 2
    assert {x.n for x in lm.refined(docs, spark.sparkContext.broadcast(raw), lm.VOCABULARY).collect()} == {200}


def test_partitions_do_not_change_a_score(spark, docs):
    """The same rows in one and in seven partitions, small blocks, equal to the last bit."""
    held, lm.TRAIN_BYTES = lm.TRAIN_BYTES, 1 << 12
    try:
        runs = [sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score, r.score) for r in lm.score(d).collect()))
                for d in (docs.coalesce(1), docs.repartition(7))]
    finally:
        lm.TRAIN_BYTES = held
    assert runs[0] == runs[1]


def test_training_windows_hold_each_token_once():
    first = np.concatenate([[0], np.cumsum([0, 5, 31, 32, 64, 200])])
    seen = Counter()
    for text, x, word, scored, end in lm.batches(first, np.arange(first[-1]), int(first[-1]), 3, 0):
        seen.update((int(t), int(w[k] - first[t])) for t, w, s in zip(text, word, scored) for k in np.flatnonzero(s))
    assert seen == {(t, p): 1 for t in range(6) for p in range(first[t + 1] - first[t] + 1)}
