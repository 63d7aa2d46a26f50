"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; it hashes the tokens under its
ones and ignores those under its zeros, so a substituted token breaks only the
placements that look at it.  Four masks are placed at every token of the
benchmark and of the documents and joined on their hashes.  Tokens are runs of
letters and digits with A-Z lowered, so case and punctuation do not matter.

Documents are filtered where they are read by a Bloom filter of the benchmark's
hashes; its size is fixed, so it can be sent everywhere however large the
benchmark is, and what it lets through wrongly falls out in the join.  What
passes keeps the tokens around it, long enough for any benchmark item.

Every hit names a diagonal (document position less item position).  If ``share`` of
the whole item's tokens match there (and nine of them, or all of a shorter item), the
item is the overlap.  Otherwise the best run of tokens on it is (a match counts 1, a
substitution -2), if it holds ``least`` matches, or all tokens of a shorter item, and
at least ``share`` of it matches.

Items with fewer tokens than the shortest seed are hashed whole, and found where all
their tokens stand one after the other; of those places a document tells the first.

Inputs and results: null and empty texts and items hold nothing; rows that repeat an id count as one document or item; an empty table gives no
overlap; a null id overlaps under the null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ints, mix, pack, slices, store, table

#: Fixed masks of weight 6: tokens under 1 count.
MASKS = ("111111", "11101101", "1101100011", "110010101001")
#: The whole of an item that is shorter than a mask.
SHORT = tuple("1" * n for n in range(1, len(MASKS[0])))
LEAST, WHOLE, SHARE = 12, 9, 0.75
#: The filter: bits, and the parts of a hash that each name one.
BITS, PARTS = 25, (0, 20, 39)
_GAP = np.zeros(256, bool)
_GAP[:128] = [not chr(c).isalnum() for c in range(128)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    words = Words.of(column, _GAP)
    return words.hashes(lower=True), words.first


def _seeds(tok: np.ndarray, first: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of one mask at every token, and which placements lie in one text."""
    shape = (MASKS + SHORT)[mask]
    n = max(0, len(tok) - len(shape) + 1)
    h = np.full(n, mask + 1, np.uint64)
    for j, bit in enumerate(shape):
        if bit == "1":
            h *= _STEP
            h += tok[j:j + n]
    whole = np.ones(n, bool)
    for j in first[1:-1]:
        whole[max(0, j - len(shape) + 1):j] = False
    return mix(h), whole


def _items(batches):
    for batch in batches:
        tok, first = _tokens(batch.column("text"))
        ids = batch.column("item").to_pylist()
        for i, item in enumerate(ids):
            own = tok[first[i]:first[i + 1]]
            hashes, places = [], []
            for m in [len(MASKS) + len(own) - 1] if 0 < len(own) <= len(SHORT) else range(len(MASKS)):
                h, _ = _seeds(own, np.array([0, len(own)]), m)
                hashes.append(h.view(np.int64))
                places.append(np.arange(len(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([item], pa.int64()), pa.array([pack(own)], pa.binary()), pa.array([len(own)], pa.int64()),
                 pa.array([np.concatenate(hashes)], pa.list_(pa.int64())),
                 pa.array([np.concatenate(places)], pa.list_(pa.int64()))],
                names=["item", "tokens", "n", "seeds", "places"])


def bloom(seeds: DataFrame) -> np.ndarray:
    """Words of the filter: at most 2**(BITS-6) rows, whatever the number of seeds."""
    bits = F.explode(F.array(*[F.shiftrightunsigned("seed", p).bitwiseAND(F.lit((1 << BITS) - 1)) for p in PARTS]))
    rows = seeds.select(bits.alias("bit")).select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` that the filter lets through."""
    at = np.arange(len(h))
    for p in PARTS:
        v = (h[at] >> np.uint64(p)) & np.uint64((1 << BITS) - 1)
        at = at[((bits[v >> np.uint64(6)] >> (v & np.uint64(63))) & np.uint64(1)).astype(bool)]
    return at


def _regions(shared, reach: int, short: list[int]):
    def run(batches):
        bits = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                tok, first = _tokens(part.column("text"))
                spots, hashes = [], []
                for m in [*range(len(MASKS)), *(len(MASKS) + n - 1 for n in short)]:
                    h, whole = _seeds(tok, first, m)
                    at = _maybe(bits, h)
                    at = at[whole[at]]
                    if m >= len(MASKS):  # the first place in each text
                        text = np.searchsorted(first, at, "right") - 1
                        o = np.lexsort((at, h[at], text))
                        new = np.ones(len(o), bool)
                        new[1:] = (h[at[o]][1:] != h[at[o]][:-1]) | (text[o][1:] != text[o][:-1])
                        at = at[o[new]]
                    spots.append(at)
                    hashes.append(h[at].view(np.int64))
                spot, hash_ = np.concatenate(spots), np.concatenate(hashes)
                if not len(spot):
                    continue
                o = np.argsort(spot, kind="stable")
                spot, hash_ = spot[o], hash_[o]
                text = np.searchsorted(first, spot, "right") - 1
                lo = np.maximum(spot - reach, first[text])
                hi = np.minimum(spot + reach, first[text + 1])
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])])
                at = np.append(np.flatnonzero(new), len(spot))
                ids = part.column("id").take(pa.array(text[at[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lo[at[:-1]] - first[text[at[:-1]]]),
                     pa.array([pack(tok[lo[a]:hi[b - 1]]) for a, b in zip(at, at[1:])], pa.binary()),
                     pa.array([hash_[a:b] for a, b in zip(at, at[1:])], pa.list_(pa.int64())),
                     pa.array([spot[a:b] - lo[a] for a, b in zip(at, at[1:])], pa.list_(pa.int64()))],
                    names=["id", "start", "tokens", "seeds", "places"])

    return run


def _best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the run with the highest sum of +1 and -2."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(end - total[:end + 1][::-1].argmin()) if end else 0
    return start, end, int(same[start:end].sum())


def _verify(least: int, share: float):
    def run(batches):
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("id", "start", "tokens", "item", "item_tokens", "shift")]
            for id_, start, tokens, item, item_tokens, shift in zip(*cols):
                a, b = np.frombuffer(tokens, np.uint64), np.frombuffer(item_tokens, np.uint64)
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                same = a[lo:hi] == b[lo - shift:hi - shift]
                s, e, hits = 0, hi - lo, int(same.sum())
                if e < len(b) or hits < min(WHOLE, e) or hits < share * e:  # not the whole item
                    s, e, hits = _best_run(same)
                    if e == s or hits < min(least, len(b)) or hits < share * (e - s):
                        continue
                out.append((id_, item, start + lo + s, lo - shift + s, e - s, hits))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["id", "item", "doc_start", "item_start", "length", "matches"])
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
             item_col: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The longest overlap of every document with every benchmark item that it holds:
    ``id_col, item_col, doc_start, item_start, length, matches`` (in tokens)."""
    items = store(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
                  .mapInArrow(_items, "item long, tokens binary, n long, seeds array<long>, places array<long>"))
    seeds = items.select("item", F.col("tokens").alias("item_tokens"), F.explode(F.arrays_zip("seeds", "places")).alias("z")) \
        .select("item", F.xxhash64("item_tokens").alias("version"), F.col("z.seeds").alias("seed"), F.col("z.places").alias("item_at"))
    reach = (items.agg(F.max("n")).first()[0] or 0) + max(map(len, MASKS))
    short = [x["n"] for x in items.where(F.col("n").between(1, len(SHORT))).select("n").distinct().collect()]  # at most five
    shared = docs.sparkSession.sparkContext.broadcast(bloom(seeds))
    regions = store(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
                    .mapInArrow(_regions(shared, reach, short),
                                "id long, start long, tokens binary, seeds array<long>, places array<long>")
                    .withColumn("region", F.xxhash64("id", "start", "tokens")))
    placed = regions.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("z")) \
        .select("region", F.col("z.seeds").alias("seed"), F.col("z.places").alias("at"))
    diagonals = placed.join(seeds, "seed").select("region", "item", "version", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    own = items.select(F.col("tokens").alias("item_tokens"), F.xxhash64("tokens").alias("version")).distinct()
    rows = diagonals.join(regions.select("region", "id", "start", "tokens").dropDuplicates(["region"]), "region").join(own, "version")
    found = rows.mapInArrow(_verify(least, share),
                            "id long, item long, doc_start long, item_start long, length long, matches long")
    best = F.max(F.struct("matches", -F.col("length"), -F.col("doc_start"), -F.col("item_start"))).alias("m")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.col3")).alias("doc_start"),
        (-F.col("m.col4")).alias("item_start"), (-F.col("m.col2")).alias("length"), "m.matches")


def op3_decontaminate(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
