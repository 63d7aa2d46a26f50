"""The pipeline against brute force, stage by stage on what the stage before kept."""
import re
from collections import defaultdict

import corpus_pipeline as cp
from tessera.llm import toxicity
from tessera.llm.common import table

from .conftest import LOWER, words
from .test_minhash import shingles
from .test_mixing import fill
from .test_pii import plain

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = cp.drop_toxic(spark, docs, SF).cache()
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    before, after = rows_of(docs), rows_of(kept)
    assert all(i in after for i, y in labels.items() if not y) and kept.columns == columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert set(after) == {r.doc_id for r in toxicity.score(docs, model).where("not rejected").collect()}

    single = cp.drop_near_duplicates(spark, kept, SF).cache()
    sets = {i: shingles(r.text) for i, r in after.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = rows_of(single)
    assert set(got) == {i for i in sets if find(i) == i} and single.columns == columns

    clean = cp.drop_contaminated(spark, single, SF).cache()
    flat = lambda t: re.findall(r"[^\W_]+", t.translate(LOWER))
    items = [" ".join(flat(r.text)) for r in table(spark, SF, "benchmark").collect()]
    have = {i for i, r in got.items() if any(f" {x} " in f" {' '.join(flat(r.text))} " for x in items)}
    left = rows_of(clean)
    assert have and not have & set(left) and len(left) >= len(got) - len(have) - 2

    safe = cp.mask_personal_data(spark, clean, SF).cache()
    masked = rows_of(safe)
    assert set(masked) == set(left) and any(plain(r.text) for r in left.values())
    for i, r in masked.items():
        assert not plain(r.text) and r.n_chars == len(r.text)
        if not plain(left[i].text):
            assert r.text == left[i].text

    mixed = cp.mix_sources(spark, safe, SF).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in masked.values():
        sizes[r.source] += len(words(r.text))
    for r in mixed:
        assert r.words == len(words(r.text))
        taken[r.source] += r.words
    want = fill(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF)
    assert set(table(spark, SF, "documents").columns) <= set(out.columns) and out.count() > 0


def test_stages_on_edge_rows(spark, docs, none):
    """Null and repeated ids, null and empty texts, extra columns; and no rows at all."""
    extra = docs.columns
    for start in (docs, none):
        df = start
        for _, stage in cp.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == extra
        n = df.count()
        assert (n > 0) == (start is docs) and cp.mix_sources(spark, df, SF).count() >= 0


def test_rows_with_null_and_shared_ids(spark, tmp_path):
    """Every row is judged by its own text, whatever its id; short items drop nothing."""
    base = "the harbour master counted forty one boats before the storm came in from the north"
    item = "a lantern was left burning in the western window of the old observatory all night"
    rows = [(1, base + " and slept"), (1, "quite another text that stands under the same id as the first one does"),
            (None, base + " and slept"), (None, f"before it {item} after it"), (None, "yes"), (None, None), (2, None), (2, ""),
            (3, f"yes {item}"), (4, "he said yes and no"), (5, base + " and slept"), (6, "six words that are like none else"),
            (6, "six words that are like none else")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _row int").repartition(3)
    spark.createDataFrame([(1, item), (2, "yes"), (None, "he said yes and no"), (4, None), (5, "")], "item_id long, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").translate(LOWER)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    got = cp.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted((r for r in rows if flat(item) not in flat(r[1])), key=key)

    single = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    want, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = frozenset(shingles(r[1]))
        if not s or not any(100 * len(s & o) >= 75 * len(s | o) for o in seen):
            want.append(r)
        seen.add(s)
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=key) == sorted(want, key=key)
