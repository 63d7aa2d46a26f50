"""Near-duplicates by circulant MinHash, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words (A-Z lowered).  Two
fixed permutations of the 64-bit numbers make the whole signature: the first
scatters the shingle hashes, the second, circularly shifted by one more step for
each coordinate, gives that coordinate as its minimum (no further hash
functions).  Bands of three coordinates become bucket keys; at similarity 0.75 a
pair shares none of 28 buckets with probability 2e-7.

1. Equal sets collapse to one class, so exact copies are never paired.
2. In each bucket every class is paired with the bucket's smallest (a star, not
   all pairs), and the pairs are confirmed on the full sets.
3. A bucket whose classes still lie in different components is settled in place:
   its sets meet as a 0/1 matrix of shared shingles, whose product holds every
   intersection, and only a spanning forest of the links leaves the task.  A large
   bucket is dealt out as pairs of blocks of bounded size.  So every pair that shares
   a bucket is confirmed, refuted or connected by others, and no pairs are emitted.

Inputs and results: null texts and texts without words have the empty set, link
with nothing and keep themselves; a shorter text is one shingle of all its
words; a null id links with nothing, has component null and is kept; rows that
repeat an id count as one document (each row gets its own set size).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, ints, mix, slices, store, table
from .links import components, roots

SHINGLE, BANDS, ROWS = 5, 28, 3
COORDS = BANDS * ROWS
#: Classes and shingles in one block of a large bucket; text bytes and pairs in one group of confirmations.
BLOCK, BLOCK_SHINGLES, GROUP_BYTES, GROUP_PAIRS = 2000, 1 << 20, 8 << 20, 2000
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    words = Words.of(column)
    h = words.hashes(lower=True)
    texts, counts = len(words.first) - 1, words.counts
    long = counts >= n
    runs = grams(h, n)
    keep = np.zeros(len(h) + 1, np.int64)
    keep[words.first[:-1][long]] += 1
    np.add.at(keep, (words.first[1:] - (n - 1))[long], -1)
    keep = np.cumsum(keep[:-1]) > 0
    text = words.text_of_word()[keep]
    value = runs[np.flatnonzero(keep)]
    for size in range(1, n):  # whole texts of fewer words
        at = np.flatnonzero(counts == size)
        if len(at):
            whole = np.zeros(len(at), np.uint64)
            for j in range(size):
                whole = whole * _SHIFT + h[words.first[at] + j]
            text = np.concatenate([text, at])
            value = np.concatenate([value, mix(whole + np.uint64(size))])
    order = np.argsort(value)
    if texts < 65536:
        order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(text[order], kind="stable")]
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(texts + 1))


def signatures(value: np.ndarray, first: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Circulant MinHash: the minimum of ``second(first(x) - k * step)`` for each k
    (rows of empty sets hold the largest number)."""
    texts = len(first) - 1
    out = np.full((texts, coords), np.uint64(2**64 - 1), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    scattered = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    at = 0
    while at < len(full):  # runs of sets that fit the cache
        to = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + (1 << 15))) - 1)
        lo, hi = first[full[at]], first[full[to - 1] + 1]
        starts = first[full[at:to]] - lo
        x = scattered[lo:hi].copy()
        for k in range(coords):
            y = x * np.uint64(0xBF58476D1CE4E5B9)
            y ^= y >> np.uint64(31)
            y *= np.uint64(0x94D049BB133111EB)
            out[full[at:to], k] = np.minimum.reduceat(y, starts)
            x -= _SHIFT  # the circular shift
        at = to
    return out


def _sketch(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            value, first = shingle_sets(part.column("text"))
            n = np.diff(first)
            sig = signatures(value, first)
            keys = np.zeros((len(n), BANDS), np.uint64)
            for r in range(ROWS):
                keys = keys * _SHIFT + sig[:, r::ROWS]
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            mark = np.zeros((len(n), 2), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                mark[full, 0] = np.add.reduceat(mix(value + np.uint64(1)), first[:-1][full])
                mark[full, 1] = np.add.reduceat(mix(value + np.uint64(2)), first[:-1][full])
            marks = mark.view(np.int64)
            ids = part.column("id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)),
                                          pa.array(keys.ravel()))],
                names=["id", "n", "m1", "m2", "keys"])


def _member_sets(t: pa.Table):
    """Sets of the table's texts, part by part: (rows, value, first)."""
    at = 0
    for part in slices(t, "text"):
        value, first = shingle_sets(part.column("text"))
        yield at, value, first
        at += part.num_rows


def _confirm(left: pa.Table, right: pa.Table) -> pa.Table:
    """``left``: (a, b, text of b); ``right``: (a, text of a).  Pairs that link."""
    found_a, found_b = [], []
    if left.num_rows and right.num_rows:
        centres = ints(right.column("a"))
        sets = [np.zeros(0, np.uint64)] * len(centres)
        for at, value, first in _member_sets(right):
            for i in range(len(first) - 1):
                sets[at + i] = value[first[i]:first[i + 1]]
        by = np.argsort(centres, kind="stable")
        left = left.take(pa.array(np.argsort(ints(left.column("a")), kind="stable")))
        a, b = ints(left.column("a")), ints(left.column("b"))
        for at, value, first in _member_sets(left):
            for i in range(len(first) - 1):
                mine = value[first[i]:first[i + 1]]
                lo = np.searchsorted(centres, a[at + i], "left", sorter=by)
                hi = np.searchsorted(centres, a[at + i], "right", sorter=by)
                for c in by[lo:hi]:
                    other = sets[c]
                    if not len(other) or not len(mine):
                        continue
                    small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                    if 100 * len(small) < 75 * len(large):
                        continue
                    spot = np.searchsorted(large, small)
                    spot[spot == len(large)] = 0
                    both = int((large[spot] == small).sum())
                    if 100 * both >= 75 * (len(mine) + len(other) - both):
                        found_a.append(a[at + i])
                        found_b.append(b[at + i])
                        break
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets link.  A group of confirmations holds
    the texts of a bounded number of pairs: an ``a`` with many partners is salted."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("s"), F.count("*").alias("n")).first()
    mean = (size["s"] or 0) / max(1, size["n"])
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.select("a", "b")
    groups = max(1, int(n_pairs * mean / GROUP_BYTES) + 1, n_pairs // GROUP_PAIRS)
    # pairs of one salt: few enough that one a never fills a group
    share = max(1, n_pairs // groups // 4)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    group = F.pmod(F.xxhash64("a", "salt"), F.lit(groups)).alias("g")
    left = dealt.select(group, "a", "b").hint("merge").join(texts.select(F.col("id").alias("b"), "text"), "b") \
        .select("g", "a", "b", "text")
    right = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")) \
        .select(group, "a").distinct().hint("merge").join(texts.select(F.col("id").alias("a"), "text"), "a").select("g", "a", "text")
    right = right.select(F.col("g").alias("g2"), F.col("a").alias("a2"), F.col("text").alias("text2"))
    return left.groupBy("g").cogroup(right.groupBy("g2")).applyInArrow(
        lambda x, y: _confirm(x, y.rename_columns(["g", "a", "text"])), "a long, b long")


def _intersections(x: list[np.ndarray], y: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices."""
    sets = x if same else x + y
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(x), len(sets) if same else len(y)), np.float32)
    width = max(256, (1 << 22) // max(1, len(sets)))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, (lo, lo + width))
        m = np.zeros((len(sets), min(width, int(shared.sum()) - lo)), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        out += m @ m.T if same else m[:len(x)] @ m[len(x):].T
    return out


def _settle(t: pa.Table) -> pa.Table:
    """Links between different components in each bucket of the group, as a forest;
    blocks ``i`` and ``j`` of a bucket are compared, or ``i`` with itself."""
    t = t.sort_by([(c, "ascending") for c in ("key", "i", "j", "own", "rep")])
    key, i, j, own, rep, comp = (ints(t.column(c)) for c in ("key", "i", "j", "own", "rep", "component"))
    sets = [value[a:b] for _, value, first in _member_sets(t) for a, b in zip(first, first[1:])]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
    found_a, found_b = [], []
    for lo, hi in zip(edge, edge[1:]):
        same = i[lo] == j[lo]
        x = np.arange(lo, hi) if same else lo + np.flatnonzero(own[lo:hi] == 0)
        y = x if same else lo + np.flatnonzero(own[lo:hi] == 1)
        if not len(x) or not len(y):
            continue
        both = _intersections([sets[k] for k in x], [sets[k] for k in y], same)
        nx, ny = (np.array([len(sets[k]) for k in z], np.float32) for z in (x, y))
        near = (100 * both >= 75 * (nx[:, None] + ny - both)) & (comp[x][:, None] != comp[y])
        r, c = np.nonzero(near)
        if len(r):
            root = roots(hi - lo, x[r] - lo, y[c] - lo)
            hung = np.flatnonzero(root != np.arange(hi - lo))
            found_a.append(rep[lo + root[hung]])
            found_b.append(rep[lo + hung])
    cat = lambda v: pa.array(np.concatenate(v) if v else [], pa.int64())
    return pa.table({"a": cat(found_a), "b": cat(found_b)})


def _settled(shared: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join components within buckets that hold several."""
    labelled = shared.where("size > 2").join(comps.select(F.col("vertex").alias("rep"), "component"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    open_ = labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"),
                                        F.sum("n").alias("shingles")).where("c1 < c2")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = store(labelled.join(open_.select("key", "shingles"), "key").withColumn("blocks", blocks)
                    .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                    .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("key", "rep", "component", "n", F.least("mine", "other").alias("i"),
                            F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("own")))
    total = members.agg(F.sum("n")).first()[0]
    if not total:
        return members.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    groups = 1 + total // BLOCK_SHINGLES
    return members.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).hint("merge") \
        .join(texts.withColumnRenamed("id", "rep"), "rep").groupBy("g").applyInArrow(lambda t: _settle(t), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketch = store(rows.mapInArrow(_sketch, "id long, n long, m1 long, m2 long, keys array<long>"))
    classes = sketch.where("n > 0 and id is not null").groupBy("m1", "m2", "n").agg(F.min("id").alias("rep"))
    of_row = sketch.select("id", "n", "m1", "m2").join(classes, ["m1", "m2", "n"], "left")
    reps = sketch.where("n > 0").join(classes.withColumnRenamed("rep", "id"), ["m1", "m2", "n", "id"], "left_semi") \
        .dropDuplicates(["id", "m1", "m2"])
    banded = store(reps.select(F.col("id").alias("rep"), "n", F.explode("keys").alias("key")))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"),
                                        F.count("*").alias("size")).where("low < high")
    shared = store(banded.join(buckets.select("key", "low", "size"), "key"))
    stars = store(shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = store(rows.join(wanted.hint("merge"), "id", "left_semi"))  # one plan at every size
    first = store(confirmed(stars, texts))
    # one document, several rows: its classes belong together
    again = of_row.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    repeats = of_row.where("rep is not null").join(again.where("a < b").select("id", "a"), "id") \
        .select("a", F.col("rep").alias("b"))
    comps = components(first.unionAll(repeats))
    more = store(_settled(shared, comps, texts))
    final = comps if more.isEmpty() else components(
        comps.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionAll(more))
    return of_row.join(final.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
