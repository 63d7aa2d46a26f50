"""Substring dedup by a compressed FM-index per shard.

A window is 13 consecutive words.  Words covered by a window that also stands in
a document with a smaller id are removed.

Every window has a minimizer, the smallest hash among its runs of three words;
neighbouring windows mostly share it.  So a document is cut into short segments
of windows with one minimizer, and a segment goes to the shard that its
minimizer names: equal windows meet in one shard, whatever surrounds them, and
the work grows with the text, not with its square.

1. Blocks of documents tell the shards their minimizers, each once, and learn which
   ones stand in several documents; nothing else can repeat.
2. Those segments go to their shards, equal ones of a block once, with their smallest
   and largest id.  Segments of a hot minimizer (more than ``HOT`` in all) are cut into
   single windows, and each goes to the shard that its own words name: a passage in
   every document costs one copy a block, what surrounds it is dealt to all shards.
   A shard collapses equal segments again, and builds an FM-index over the rest:
   suffixes ordered by 16 words, the Burrows-Wheeler transform as a wavelet
   matrix of packed bits with rank counts, one symbol per distinct word.
   Backward search extends all windows of all segments leftwards at once, until
   a window matches only itself or its full length; the suffixes it matches
   give the smallest id that holds it.  Words are looked up by 64-bit hashes.
3. The matched intervals and the smallest ids go back to their blocks, which find all
   places of each segment again and cut the texts whose id is larger.

Blocks and shards have a bounded mean size, and their number grows with the
text.  Inputs and results: null and empty texts have no word; rows that repeat
an id never remove each other's words; a null id counts as the largest; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks_for, grams, ints, mix, pack, slices, table

WINDOW, SEED_WORDS, MOST_WINDOWS = 13, 3, 32
#: Text in a block: fewer and larger blocks exchange less, smaller ones need less memory.
BLOCK_BYTES = 12 << 20
#: An index needs several times its segments in memory, so there are more shards than blocks.
SHARDS_PER_BLOCK = 2
#: So many segments of one minimizer are about a shard of mean size.
HOT = 1 << 15
NULL_ID = 2**63 - 1


class Segments:
    """Runs of windows of one text that share a minimizer: word range of each
    (``at`` to ``at + windows + WINDOW - 1``, in the slice), text and minimizer."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int = WINDOW):
        self.text = self.at = self.windows = np.zeros(0, np.int64)
        self.minimizer = np.zeros(0, np.uint64)
        seeds = grams(hashes, SEED_WORDS)
        n = len(hashes) - window + 1
        if n <= 0:
            return
        span, low, width = window - SEED_WORDS + 1, seeds, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        inside = np.zeros(n + 1, np.int64)
        fits = np.diff(first) >= window
        np.add.at(inside, first[:-1][fits], 1)
        np.add.at(inside, first[1:][fits] - window + 1, -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(start):
            return
        text = np.searchsorted(first, start, "right") - 1
        m = low[start]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (m[1:] != m[:-1])])
        begin = np.flatnonzero(new)
        within = np.arange(len(start)) - np.repeat(begin, np.diff(np.append(begin, len(start))))
        begin = np.flatnonzero(within % MOST_WINDOWS == 0)
        self.text, self.at, self.minimizer = text[begin], start[begin], m[begin]
        self.windows = np.diff(np.append(begin, len(start)))

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """The (text, minimizer) pairs, each once, by minimizer; and each segment's pair."""
        o = np.lexsort((self.text, self.minimizer))
        t, m = self.text[o], self.minimizer[o]
        new = np.ones(len(o), bool)
        new[1:] = (t[1:] != t[:-1]) | (m[1:] != m[:-1])
        pair = np.empty(len(o), np.int64)
        pair[o] = np.cumsum(new) - 1
        return m[new], pair

    def single(self, minimizers: np.ndarray) -> np.ndarray:
        """Cuts the segments of the minimizers into their windows; which ones those are."""
        hot = np.isin(self.minimizer, minimizers)
        n = np.where(hot, self.windows, 1)
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        self.at = np.repeat(self.at, n) + within
        self.text, self.minimizer = np.repeat(self.text, n), np.repeat(self.minimizer, n)
        self.windows = np.repeat(np.where(hot, 1, self.windows), n)
        return np.repeat(hot, n)


class WaveletMatrix:
    """Rank over a sequence of symbols, a packed bit vector per bit of the symbols."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int32))])[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(symbols)
        self.base = np.zeros(symbols, np.int64)
        self.base = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & below)
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``i``."""
        return self._walk(symbol, i) - self.base[symbol]


class FMIndex:
    """Over a sequence of symbols (0 separates texts); finds patterns of up to 16 symbols."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        rank = seq.astype(np.int64)
        for h in (1, 2, 4, 8):
            after = np.zeros(n, np.int64)
            after[:n - h] = rank[h:] + 1
            _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        self.suffixes = np.sort(rank * n + np.arange(n)) % n
        bwt = seq[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.wavelet = WaveletMatrix(bwt, symbols)

    def extend(self, symbol, lo, hi):
        """Suffix intervals of ``symbol`` followed by what the intervals match."""
        c = self.first[symbol]
        return c + self.wavelet.rank(symbol, lo), c + self.wavelet.rank(symbol, hi)

    def search(self, seq: np.ndarray, start: np.ndarray, length: int):
        """Intervals of the patterns ``seq[start:start + length]``, which stand in the
        index; a pattern is left at its last step once a single suffix matches."""
        symbol = seq[start + length - 1]
        lo, hi = self.first[symbol].copy(), self.first[symbol + 1].copy()
        active = np.flatnonzero(hi - lo > 1)
        for j in range(length - 2, -1, -1):
            if not len(active):
                break
            for k in range(0, len(active), 1 << 16):
                a = active[k:k + (1 << 16)]
                lo[a], hi[a] = self.extend(seq[start[a] + j], lo[a], hi[a])
            active = active[hi[active] - lo[active] > 1]
        return lo, hi


def _sorted_block(t: pa.Table) -> pa.Table:
    return t.sort_by([("id", "ascending"), ("mark", "ascending")])


def _segments_of(t: pa.Table):
    """Slices of the block in order: (first row, words, hashes, segments)."""
    at = 0
    for part in slices(t, "text"):
        words = Words.of(part.column("text"))
        h = words.hashes()
        yield at, words, h, Segments(h, words.first)
        at += part.num_rows


def _told(segments, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's minimizers, each once, by shard; their shards; which ones several of its
    texts hold; and how many segments have each."""
    m = np.concatenate([np.zeros(0, np.uint64)] + [s.told()[0] for _, _, _, s in segments])
    m, n = np.unique(m, return_counts=True)
    shard = (m % np.uint64(shards)).astype(np.int64)
    o = np.argsort(shard, kind="stable")
    _, count = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [s.minimizer for _, _, _, s in segments]), return_counts=True)
    return m[o], shard[o], n[o] > 1, count[o]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.diff(x, prepend=-1, append=-1)) if len(x) else np.zeros(0, np.int64)


def _words_at(h: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return h[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - length), length)]


def _equal(word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal segments are one, known by two sums over hashes of word and place: the
    order that brings them together, which begin a group there, and each one's group."""
    begin = np.cumsum(length) - length
    place = np.arange(len(word)) - np.repeat(begin, length)
    spread = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = np.add.reduceat(mix(word + spread), begin)
    b = np.add.reduceat(mix(word ^ ~spread), begin)
    o = np.lexsort((b, a, length))
    new = np.ones(len(o), bool)
    new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1]) | (length[o][1:] != length[o][:-1])
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(new) - 1
    return o, new, group


def _tell(shards: int):
    def run(t: pa.Table) -> pa.Table:
        m, shard, several, count = _told(list(_segments_of(_sorted_block(t))), shards)
        edge = _edges(shard)
        block = t.column("block")[0].as_py() if t.num_rows else 0
        lo = edge[:-1]
        return pa.table({
            "shard": pa.array(shard[lo], pa.int32()), "block": pa.array(np.full(len(lo), block), pa.int32()),
            "told": pa.array([pack(m[a:b]) for a, b in zip(edge, edge[1:])], pa.binary()),
            "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
            "count": pa.array([pack(count[a:b].astype(np.uint32)) for a, b in zip(edge, edge[1:])], pa.binary())})
    return run


def _answer(t: pa.Table, hot: int = HOT) -> pa.Table:
    """Which of the told minimizers several texts hold (a block tells each once), and
    which have more than ``hot`` segments."""
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("told")]
    _, code = np.unique(np.concatenate(rows), return_inverse=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k))
                              for x, k in zip(t.column("several"), rows)])
    count = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("count")])
    many = (np.bincount(code, 1.0 + several) > 1)[code]
    hot = (np.bincount(code, count) > hot)[code] & many
    cut = np.cumsum([0, *map(len, rows)])
    bits = lambda x: pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
    return pa.table({"to": t.column("block"), "shard": t.column("shard"), "many": bits(many), "hot": bits(hot)})


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("id").fill_null(NULL_ID).to_numpy() if t.num_rows else np.zeros(0, np.int64)


def _send(shards: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _sorted_block(t)
        segments = [(at, words.first, h, s) for at, words, h, s in _segments_of(t)]
        m, shard, _, _ = _told(segments, shards)
        edge = _edges(shard)

        def named(column):
            bits = dict(zip(answers.column("shard").to_pylist(), answers.column(column).to_pylist()))
            return m[np.concatenate([np.zeros(0, bool)] + [
                np.unpackbits(np.frombuffer(bits[int(shard[a])], np.uint8), count=b - a).astype(bool) for a, b in zip(edge, edge[1:])])]

        shared, hot = named("many"), named("hot")
        parts: dict[int, list] = {}
        ids = _ids(t)
        for at, first, h, s in segments:
            name, alone = s.minimizer, np.zeros(len(s.minimizer), bool)
            if len(hot):
                alone = s.single(hot)
                name = s.minimizer.copy()
                name[alone] = grams(h, WINDOW)[s.at[alone]] if alone.any() else 0
            seg = np.flatnonzero(np.isin(s.minimizer, shared))
            to = (name[seg] % np.uint64(shards)).astype(np.int64)
            o = np.argsort(to, kind="stable")
            seg, to = seg[o], to[o]
            edge = _edges(to)
            for a, b in zip(edge, edge[1:]):
                g = seg[a:b]
                length = s.windows[g] + WINDOW - 1
                parts.setdefault(int(to[a]), []).append(
                    (at + s.text[g], np.where(alone[g], ~(s.at[g] - first[s.text[g]]), s.at[g] - first[s.text[g]]), length, _words_at(h, s.at[g], length)))
        rows = {c: [] for c in ("shard", "block", "row", "id", "top", "start", "length", "lexicon", "words")}
        block = t.column("block")[0].as_py() if t.num_rows else 0
        for k, p in parts.items():
            row, start, length, word = (np.concatenate(x) for x in zip(*p))
            o, new, _ = _equal(word, length)
            head = np.flatnonzero(new)
            pick = o[head]  # the first in the block
            id_ = ids[row[o]]
            word = _words_at(word, (np.cumsum(length) - length)[pick], length[pick])
            lexicon, code = np.unique(word, return_inverse=True)
            rows["shard"].append(k)
            rows["block"].append(block)
            rows["row"].append(pack(row[pick].astype(np.int32)))
            rows["id"].append(pack(np.minimum.reduceat(id_, head)))
            rows["top"].append(pack(np.maximum.reduceat(id_, head)))
            rows["start"].append(pack(start[pick].astype(np.int32)))
            rows["length"].append(pack(length[pick].astype(np.uint8)))
            rows["lexicon"].append(pack(lexicon))
            rows["words"].append(pack(code.astype(np.uint16 if len(lexicon) <= 65536 else np.uint32)))
        return pa.table({c: pa.array(v, pa.int32() if c in ("shard", "block") else pa.binary()) for c, v in rows.items()})
    return run


def _match(t: pa.Table) -> pa.Table:
    """The shard's index and search: by block and segment (its first row and word there, the
    word's complement for a window of a hot minimizer),
    runs of windows that a smaller id than the segment's largest holds, and that id."""
    get = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]
    lengths = get("length", np.uint8)
    lexicons = get("lexicon", np.uint64)
    lexicon = np.unique(np.concatenate(lexicons))
    words = np.concatenate([
        np.searchsorted(lexicon, x)[np.frombuffer(w.as_buffer(), np.uint16 if len(x) <= 65536 else np.uint32)]
        for x, w in zip(lexicons, t.column("words"))]).astype(np.int32) + 1
    length = np.concatenate(lengths).astype(np.int64)
    id_ = np.concatenate(get("id", np.int64))
    most = np.concatenate(get("top", np.int64))
    start = np.concatenate(get("start", np.int32))
    row = np.concatenate(get("row", np.int32))
    source = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
    begin = np.cumsum(length) - length
    o, new, group = _equal(lexicon[words - 1], length)
    pick = o[new]
    least = np.minimum.reduceat(id_[o], np.flatnonzero(new))
    del o
    # the text: each distinct segment and a separator
    plen = length[pick]
    pos = np.cumsum(plen + 1) - (plen + 1)
    total = int((plen + 1).sum())
    seq = np.zeros(total, np.int32)
    ends = np.cumsum(plen)
    inner = np.arange(ends[-1]) - np.repeat(ends - plen, plen)
    seq[np.repeat(pos, plen) + inner] = words[np.repeat(begin[pick], plen) + inner]
    del words, inner
    index = FMIndex(seq, len(lexicon) + 1)
    owner = np.repeat(np.arange(len(pick)), plen + 1)
    n_win = plen - WINDOW + 1
    wend = np.cumsum(n_win)
    wstart = wend - n_win
    window_at = np.repeat(pos, n_win) + np.arange(wend[-1]) - np.repeat(wstart, n_win)
    smallest = np.repeat(least, n_win)
    lo, hi = index.search(seq, window_at, WINDOW)
    multi = np.flatnonzero(hi - lo > 1)
    if len(multi):  # intervals of equally long patterns are equal or disjoint
        u, inv = np.unique(lo[multi], return_inverse=True)
        top = np.zeros(len(u), np.int64)
        top[inv] = hi[multi]
        by_suffix = np.append(least[owner[index.suffixes]], NULL_ID)
        smallest[multi] = np.minimum.reduceat(by_suffix, np.stack([u, top], 1).ravel())[::2][inv]
    # back to every block's segment
    k = n_win[group]
    cut = np.cumsum(k)
    win = np.arange(cut[-1]) - np.repeat(cut - k, k)
    occ = np.repeat(np.arange(len(group)), k)
    small = smallest[np.repeat(wstart[group], k) + win]
    g = np.flatnonzero(small < most[occ])
    if not len(g):
        return pa.table({"to": pa.array([], pa.int32()), "spans": pa.array([], pa.binary()), "least": pa.array([], pa.binary())})
    head = np.concatenate([[True], (np.diff(g) != 1) | (occ[g][1:] != occ[g][:-1]) | (small[g][1:] != small[g][:-1])])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(g) - 1)
    head = np.flatnonzero(head)
    o_ = occ[g[head]]
    spans = np.stack([row[o_], start[o_], win[g[head]], win[g[last]] + WINDOW], 1).astype(np.int32)
    small = small[g[head]]
    blocks = ints(t.column("block"))[source[o_]]
    order = np.argsort(blocks, kind="stable")
    edge = np.flatnonzero(np.diff(blocks[order], prepend=-1, append=-1))
    return pa.table({"to": pa.array(blocks[order][edge[:-1]], pa.int32()),
                     "spans": pa.array([pack(spans[order[x:y]]) for x, y in zip(edge, edge[1:])], pa.binary()),
                     "least": pa.array([pack(small[order[x:y]]) for x, y in zip(edge, edge[1:])], pa.binary())})


def _places(segments, ids: np.ndarray, runs: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows and word intervals to remove: ``runs`` of segments, at every place of the
    segment in the block whose id is larger than ``least``."""
    # segments stand by row and start, so a segment is found by both
    alone = runs[:, 1] < 0  # a window of a hot minimizer
    asked = runs[:, 0].astype(np.int64) << 32 | np.where(alone, ~runs[:, 1], runs[:, 1])

    def listed():
        row, start, minimizer = (np.concatenate(x) for x in zip(*[
            (at + s.text, s.at - words.first[s.text], s.minimizer) for at, words, _, s in segments]))
        return row, start, minimizer, np.searchsorted(row.astype(np.int64) << 32 | start, asked, "right") - 1

    row, start, minimizer, own = listed()
    if alone.any():
        for _, _, _, s in segments:
            s.single(np.unique(minimizer[own[alone]]))
        row, start, minimizer, own = listed()
    wanted = np.unique(minimizer[own])
    seen, length, word = [], [], []
    n = 0
    for _, words, h, s in segments:
        g = np.flatnonzero(np.isin(s.minimizer, wanted))
        seen.append(n + g)
        length.append(s.windows[g] + WINDOW - 1)
        word.append(_words_at(h, s.at[g], length[-1]))
        n += len(s.minimizer)
    seen = np.concatenate(seen)
    o, new, group = _equal(np.concatenate(word), np.concatenate(length))
    first = np.append(np.flatnonzero(new), len(o))
    of = group[np.searchsorted(seen, own)]  # the group of each run
    count = first[of + 1] - first[of]
    ends = np.cumsum(count)
    run = np.repeat(np.arange(len(runs)), count)
    place = seen[o[np.arange(ends[-1]) + np.repeat(first[of] - (ends - count), count)]]
    gone = np.flatnonzero(least[run] < ids[row[place]])
    run, place = run[gone], place[gone]
    return np.stack([row[place], start[place] + runs[run, 2], start[place] + runs[run, 3]], 1).astype(np.int64)


def _cut(t: pa.Table, found: pa.Table) -> pa.Table:
    t = _sorted_block(t)
    spans = np.zeros((0, 3), np.int64)
    if found.num_rows:
        spans = _places(list(_segments_of(t)), _ids(t), *(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in found.column(c)]).reshape(shape)
                                                          for c, kind, shape in (("spans", np.int32, (-1, 4)), ("least", np.int64, -1))))
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    at, out = 0, {"id": [], "n_words": [], "n_removed": [], "kept": [], "spans": []}
    for part in slices(t, "text"):
        words = Words.of(part.column("text"))
        own = spans[np.searchsorted(spans[:, 0], at):np.searchsorted(spans[:, 0], at + part.num_rows)]
        edge = np.zeros(len(words) + 1, np.int64)
        base = words.first[own[:, 0] - at]
        np.add.at(edge, base + own[:, 1], 1)
        np.add.at(edge, base + own[:, 2], -1)
        gone = np.cumsum(edge[:-1]) > 0
        hit = np.zeros(part.num_rows, bool)
        hit[own[:, 0] - at] = True
        for r in range(part.num_rows):
            a, b = words.first[r], words.first[r + 1]
            text = words.data[words.offsets[r]:words.offsets[r + 1]].tobytes().split()
            runs = []
            if hit[r]:
                g = gone[a:b]
                text = [w for w, x in zip(text, g.tolist()) if not x]
                turn = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                runs = turn.tolist()
            out["n_words"].append(b - a)
            out["n_removed"].append(b - a - len(text))
            out["kept"].append(b" ".join(text))
            out["spans"].append(runs)
        out["id"].append(part.column("id").combine_chunks())
        at += part.num_rows
    return pa.table({"id": pa.chunked_array(out["id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                     "n_removed": pa.array(out["n_removed"], pa.int64()),
                     "kept": pa.array(out["kept"], pa.binary()).cast(pa.string()),
                     "removed": pa.array(out["spans"], pa.list_(pa.int64()))})


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` (words kept, joined by one space) and
    ``removed`` (word numbers where removed runs begin and end, alternating)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n = blocks_for(rows, "text", BLOCK_BYTES)
    # the same blocks serve three steps of one plan; Spark shuffles the texts once
    blocks = rows.withColumn("mark", F.xxhash64("text")).withColumn(
        "block", F.pmod(F.xxhash64("id", "mark"), F.lit(n)).cast("int")).groupBy("block")
    shards = SHARDS_PER_BLOCK * n
    told = blocks.applyInArrow(_tell(shards), "shard int, block int, told binary, several binary, count binary")
    many = told.groupBy("shard").applyInArrow(lambda t: _answer(t, hot), "to int, shard int, many binary, hot binary")
    sent = blocks.cogroup(many.groupBy("to")).applyInArrow(
        _send(shards), "shard int, block int, row binary, id binary, top binary, start binary, length binary, lexicon binary, words binary")
    spans = sent.groupBy("shard").applyInArrow(lambda t: _match(t), "to int, spans binary, least binary")
    return blocks.cogroup(spans.groupBy("to")).applyInArrow(
        lambda t, f: _cut(t, f), "id long, n_words long, n_removed long, kept string, removed array<long>") \
        .withColumnRenamed("id", id_col)


def op1_substring(spark, sf_dir):
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p
         FROM g JOIN m USING (g) WHERE low < doc_id),
k AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
