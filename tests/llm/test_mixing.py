from collections import defaultdict

import pytest

from tessera.llm.mixing import mix, repeated

from .conftest import words


def fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by the process itself: share out, clamp, share the excess out again."""
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(max(0, target[s] - epochs * sizes[s]) for s in names)
        for s in names:
            if target[s] >= epochs * sizes[s]:
                target[s] = epochs * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_takes(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = fill(sizes)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size) for r in got) == \
        sorted(((r.doc_id is None, r.doc_id or 0), len(words(r.text))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mix(docs).collect()))  # reruns agree


def test_other_seed_takes_others(docs):
    one, two = ({(r.doc_id, r.taken) for r in mix(docs, seed=s).collect()} for s in ("a", "b"))
    assert one != two


def test_repetitions_hold_the_words_taken(docs):
    got = repeated(docs).collect()
    want = defaultdict(int)
    for r in mix(docs).collect():
        want[r.doc_id, r.size] += r.taken
    for r in got:
        assert r.words == len(words(r.text)) > 0
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.words
    by_id = defaultdict(int)
    for (i, _), t in want.items():
        by_id[i] += t
    assert {i: t for i, t in by_id.items() if t} == dict(total)
    assert set(docs.columns) <= set(got[0].asDict())


def test_native_plan_only(docs):
    plan = mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_no_words(none, spark):
    assert mix(none).count() == 0 and repeated(none).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mix(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
