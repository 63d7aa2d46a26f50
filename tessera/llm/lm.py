"""Language-model scoring: a causal self-attention model in numpy on subword ids.

Tokens are words (A-Z lowered) and one end.  A word enters the model as the sum
of the embeddings of its byte-pair subword ids (a public vocabulary, never
trained).  One causal attention layer with learned distance terms reads the words
before a token and predicts the token's class; the word within its class follows
the counts of all training documents:

    p(word | before) = p(class | before) * (c + 0.5) / (N_class + 0.5 * (V_class + 1))

so the model differs from the base score in exactly what attention knows of the
next class.  Classes gather words by what stands around them: endings and
beginnings are hashed to buckets, and the buckets are clustered by their contexts.

Texts are cut into windows of 32 tokens that overlap by 8: a window scores only
tokens that no earlier one scored, each with at least 8 tokens before it (all
there are, near a text's start).  Windows of many texts run as one batch of
masked matrix products.

What is learned from where: counts, class sizes and the contexts of the classes from
every training document; the first weights, where training begins, from at most
``sample`` documents; then every block of training documents (dealt by the hash of the
text, read in its order) trains these weights further on all its tokens and the results
are averaged.  So how a table is split does not change a score.  Contexts and weights
have a fixed size and are added up in two steps, so that no group grows with the corpus.

Word counts never meet in one place: words go to shards by hash, and each block of
documents asks the shards only for the counts of its own words.  Null texts are
empty (their only token is the end); rows that repeat an id are ordinary rows; a
null id counts as training; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Words, blocks_for, pack, slices, store, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words are given one to a line; a line is one piece for the vocabulary's merges.
PATTERN = r"[^\n]+|\n"
CONTEXT, OVERLAP, WIDTH, CLASSES, ROWS = 32, 8, 16, 32, 1 << 14
END = CLASSES  # the class of the end
BUCKETS, DIMS = 1 << 13, 128
SAMPLE = 1500
#: Bytes of training text of one block, whose weights start from the first ones.
TRAIN_BYTES = 16 << 20
#: Bytes of text after which a block's subwords learn what its words did.
SLICE = 2 << 20
_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def subwords(words: Words, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the chosen words (A-Z lowered), one after the other, and how many
    each has.  One call encodes all of them."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = words.end[at] - words.start[at] + 1
    ends = np.cumsum(size)
    place = np.minimum(np.arange(ends[-1]) + np.repeat(words.start[at] - (ends - size), size), len(words.data) - 1)
    lines = _LOWER[words.data[place]]
    lines[ends - 1] = 10
    enc = encoder(path)
    ids = np.array(enc.encode_ordinary(lines.tobytes().decode()), np.int64)
    stop = np.flatnonzero(ids == enc.encode_single_token("\n"))
    n = np.diff(stop, prepend=-1) - 1
    return np.delete(ids, stop) % ROWS, n


def buckets_of(words: Words, at: np.ndarray) -> np.ndarray:
    """A bucket of each chosen word by its first two and last three bytes."""
    out = np.zeros(len(at), np.uint64)
    start, end = words.start[at], words.end[at]
    for j in range(5):
        p = np.minimum(start + j, end - 1) if j < 2 else np.maximum(end - (j - 1), start)
        b = words.data[p].astype(np.uint64)
        b = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
        out = out * np.uint64(0x100000001B3) + b
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS)


class Model:
    """``emb`` rows of subword ids (last: the begin), attention, classes of buckets."""

    PARTS = ("emb", "q", "k", "v", "o", "far", "out", "bias")

    def __init__(self, classes: np.ndarray, **parts):
        self.classes = classes
        for k in self.PARTS:
            setattr(self, k, parts[k].astype(np.float32))

    @classmethod
    def fresh(cls, classes: np.ndarray, seed: int = 5) -> "Model":
        r = np.random.default_rng(seed)
        d = WIDTH
        return cls(classes, emb=r.normal(0, 0.3, (ROWS + 1, d)), q=r.normal(0, 0.3, (d, d)), k=r.normal(0, 0.3, (d, d)),
                   v=r.normal(0, 0.3, (d, d)), o=r.normal(0, 0.3, (d, d)), far=np.zeros(CONTEXT),
                   out=r.normal(0, 0.3, (d, CLASSES + 1)), bias=np.zeros(CLASSES + 1))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.PARTS])

    def with_flat(self, flat: np.ndarray) -> "Model":
        parts, at = {}, 0
        for k in self.PARTS:
            a = getattr(self, k)
            parts[k] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        return Model(self.classes, **parts)

    def to_bytes(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, classes=self.classes, **{k: getattr(self, k) for k in self.PARTS})
        return buf.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Model":
        return cls(**np.load(io.BytesIO(raw)))

    def vectors(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row per word from its subword ids."""
        out = np.zeros((len(n), WIDTH), np.float32)
        if len(n):
            out[:] = np.add.reduceat(self.emb[ids], np.cumsum(n) - n) / np.sqrt(n)[:, None]
        return out

    def mask(self) -> np.ndarray:
        """Distance terms below the diagonal, nothing above it."""
        far = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)
        return np.where(far >= 0, self.far[np.abs(far)], np.float32(-1e9)).astype(np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        q, k, v = x @ (self.q / np.float32(WIDTH ** 0.5)), x @ self.k, x @ self.v
        a = q @ k.transpose(0, 2, 1)
        a += mask
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        m = a @ v
        h = x + m @ self.o
        z = h @ self.out + self.bias
        z -= z.max(-1, keepdims=True)
        z -= np.log(np.exp(z).sum(-1, keepdims=True))
        return z, (q, k, v, a, m, h)

    def target_logs(self, x: np.ndarray, target: np.ndarray, scored: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat places of the scored positions and the log probability of each one's target.
        The output layer runs on these positions only."""
        d = WIDTH
        flat = lambda t: t.reshape(-1, t.shape[-1])
        joint = np.concatenate([self.q / np.float32(d ** 0.5), self.k, self.v], 1)
        q, k, v = np.split((flat(x) @ joint).reshape(*x.shape[:2], 3 * d), 3, axis=2)
        a = q @ k.transpose(0, 2, 1)
        a += mask
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        total = a.sum(-1, keepdims=True)
        m = (a @ v) / total
        rows = np.flatnonzero(scored)
        z = (flat(x)[rows] + flat(m)[rows] @ self.o) @ self.out
        z += self.bias
        z -= z.max(-1, keepdims=True)
        hit = z[np.arange(len(rows)), target.ravel()[rows]]
        return rows, hit - np.log(np.exp(z, out=z).sum(-1))

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, mask: np.ndarray):
        """Mean loss over the weighted positions, gradients of the parts and of the inputs.
        Products over all positions are taken once for q, k and v together."""
        d, root = WIDTH, x.dtype.type(WIDTH ** 0.5)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        joint = np.concatenate([self.q / root, self.k, self.v], 1)
        q, k, v = np.split((flat(x) @ joint).reshape(*x.shape[:2], 3 * d), 3, axis=2)
        a = q @ k.transpose(0, 2, 1)
        a += mask
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        m = a @ v
        h = flat(x) + flat(m) @ self.o
        dz = h @ self.out
        dz += self.bias
        dz -= dz.max(-1, keepdims=True)
        rows, goal, w = np.arange(len(h)), target.ravel(), weight.ravel()
        hit = dz[rows, goal]
        np.exp(dz, out=dz)
        total = dz.sum(-1)
        n = max(1.0, float(w.sum()))
        loss = float(((np.log(total) - hit) * w).sum()) / n
        w = w / x.dtype.type(n)
        dz *= (w / total)[:, None]
        dz[rows, goal] -= w
        g = {"out": h.T @ dz, "bias": dz.sum(0)}
        dh = dz @ self.out.T
        g["o"] = flat(m).T @ dh
        dm = (dh @ self.o.T).reshape(m.shape)
        ds = dm @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dm
        ds -= np.einsum("bij,bij->bi", ds, a)[..., None]
        ds *= a
        g["far"] = np.bincount(_FAR, ds.sum(0).ravel()[_BELOW], CONTEXT).astype(x.dtype)
        both = flat(np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, dv], 2))
        g["q"], g["k"], g["v"] = np.split(flat(x).T @ both, 3, axis=1)
        g["q"] = g["q"] / root
        dx = dh + both @ joint.T
        return loss, g, dx.reshape(x.shape)


#: Cells on and below the diagonal of a window's attention, and how far back each looks.
_FAR = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)
_BELOW = np.flatnonzero(_FAR >= 0)
_FAR = _FAR.ravel()[_BELOW]


def windows(first: np.ndarray, overlap: int = OVERLAP):
    """Windows over texts of ``words + 1`` tokens: (text, first position, first position
    that is scored, one past the last)."""
    n = np.diff(first) + 1
    more = np.maximum(0, -(-(n - CONTEXT) // (CONTEXT - overlap)))
    text = np.repeat(np.arange(len(n)), more + 1)
    k = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    scored = np.where(k == 0, 0, CONTEXT + (k - 1) * (CONTEXT - overlap))
    begin = np.maximum(0, scored - overlap)
    return text, begin, scored, np.minimum(n[text], begin + CONTEXT)


def batches(first: np.ndarray, code: np.ndarray, n_codes: int, size: int = 192, overlap: int = OVERLAP):
    """Batches of windows: (text, input codes, word index of each target, which
    positions are scored, and which of these are ends)."""
    text, begin, scored, stop = windows(first, overlap)
    for k in range(0, len(text), size):
        t, b = text[k:k + size], begin[k:k + size]
        pos = b[:, None] + np.arange(CONTEXT)
        word = first[t][:, None] + pos
        inside = pos < stop[k:k + size][:, None]
        end = pos == (first[t + 1] - first[t])[:, None]
        x = np.full(pos.shape, n_codes + 1, np.int64)
        known = inside & (pos > 0)
        x[known] = code[word[known] - 1]
        x[inside & (pos == 0)] = n_codes
        yield t, x, word, inside & (pos >= scored[k:k + size][:, None]), end


class Lexicon:
    """Distinct words of some texts: subword ids, bucket; and each word's number."""

    def __init__(self, words: Words, hashes: np.ndarray, path: str):
        _, at, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        self.ids, self.n = subwords(words, at, path)
        self.buckets = buckets_of(words, at).astype(np.int64)


def contexts(text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How often a word of each bucket stands at most eight places after, and in the same
    text as, a word of each bucket modulo ``DIMS``."""
    ctx = np.zeros(BUCKETS * DIMS, np.int64)
    for gap in range(1, 9):
        same = text[gap:] == text[:-gap]
        ctx += np.bincount((bucket[gap:].astype(np.int64) * DIMS + bucket[:-gap].astype(np.int64) % DIMS)[same], minlength=len(ctx))
    return ctx.reshape(BUCKETS, DIMS)


def cluster(ctx: np.ndarray, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Classes of buckets by their contexts: k-means on the square roots of their shares."""
    n = ctx.sum(1)
    overall = np.sqrt((ctx.sum(0) + 1) / (ctx.sum() + DIMS))
    x = np.sqrt((ctx + 20 * overall ** 2) / (n + 20)[:, None]) - overall
    weight = np.sqrt(n)
    seen = np.flatnonzero(n > 0)
    r = np.random.default_rng(seed)
    out = np.zeros(BUCKETS, np.int16)
    if len(seen) < CLASSES:
        out[seen] = np.arange(len(seen))
        return out
    centre = x[r.choice(seen, CLASSES, replace=False, p=weight[seen] / weight[seen].sum())]
    for _ in range(rounds):
        d = ((x[seen] ** 2).sum(1)[:, None] - 2 * x[seen] @ centre.T + (centre ** 2).sum(1))
        own = d.argmin(1)
        for c in range(CLASSES):
            m = seen[own == c]
            if len(m):
                centre[c] = (x[m] * weight[m, None]).sum(0) / weight[m].sum()
    out[seen] = own
    return out


def train_on(model: Model, texts, path: str, epochs: int, rate: float) -> Model:
    """Adagrad over the windows of the texts (slices of a table)."""
    sums = {k: np.full(getattr(model, k).shape, 1e-4, np.float32) for k in Model.PARTS}
    r = np.random.default_rng(1)
    for _ in range(epochs):
        for part in texts:
            words = Words.of(part.column("text"))
            lex = Lexicon(words, words.hashes(lower=True), path)
            cls = np.append(model.classes[lex.buckets][lex.code], END).astype(np.int64)
            flat, n_ids, known = lex.ids, lex.n, len(lex.n)
            begin = np.cumsum(n_ids) - n_ids
            todo = list(batches(words.first, lex.code, known, 48))
            for i in r.permutation(len(todo)):
                _, x, word, scored, end = todo[i]
                # the batch's words (u): their subword rows, and which word each belongs to
                u, inv = np.unique(x, return_inverse=True)
                inv = inv.reshape(x.shape)
                w = u[u < known]
                n = n_ids[w]
                owner = np.repeat(np.arange(len(w)), n)
                rows = flat[np.arange(len(owner)) + np.repeat(begin[w] - (np.cumsum(n) - n), n)]
                vec = np.zeros((len(u), WIDTH), np.float32)
                if len(w):
                    vec[:len(w)] = np.add.reduceat(model.emb[rows], np.cumsum(n) - n) / np.sqrt(n)[:, None]
                vec[u == known] = model.emb[ROWS]
                target = cls[np.where(end | ~scored, len(cls) - 1, np.minimum(word, len(cls) - 1))]
                _, g, dx = model.gradients(vec[inv], target, scored.astype(np.float32), model.mask())
                dv = _sum_rows(inv.ravel(), dx.reshape(-1, WIDTH), len(u))
                rows = np.append(rows, ROWS)
                hit, spot = np.unique(rows, return_inverse=True)
                grad = _sum_rows(spot, np.concatenate([dv[owner] / np.sqrt(n)[owner, None], dv[u == known].sum(0)[None]]), len(hit))
                sums["emb"][hit] += grad ** 2
                model.emb[hit] -= rate * grad / np.sqrt(sums["emb"][hit])
                for key, grad in g.items():
                    sums[key] += grad ** 2
                    getattr(model, key)[...] -= rate * grad / np.sqrt(sums[key])
    return model


def refine_on(model: Model, table: pa.Table, path: str, rate: float, size: int = 192) -> Model:
    """One pass of Adagrad over every token of the texts.  A slice's words get their vectors at
    its start and hand what they learnt to their subwords at its end; windows do not overlap,
    as each token is to be learnt from once."""
    sums = {k: np.full(getattr(model, k).shape, 1e-4, np.float32) for k in Model.PARTS}
    r = np.random.default_rng(1)
    for part in slices(table, "text", SLICE):
        words = Words.of(part.column("text"))
        lex = Lexicon(words, words.hashes(lower=True), path)
        cls = np.append(model.classes[lex.buckets][lex.code], END).astype(np.int64)
        known = len(lex.n)
        vec = np.zeros((known + 2, WIDTH), np.float32)   # words, begin, padding
        vec[:known], vec[known] = model.vectors(lex.ids, lex.n), model.emb[ROWS]
        learnt = np.zeros_like(vec)
        todo = list(batches(words.first, lex.code, known, size, 0))
        for i in r.permutation(len(todo)):
            _, x, word, scored, end = todo[i]
            target = cls[np.where(end | ~scored, len(cls) - 1, np.minimum(word, len(cls) - 1))]
            _, g, dx = model.gradients(vec[x], target, scored.astype(np.float32), model.mask())
            _add_rows(learnt, x.ravel(), dx.reshape(-1, WIDTH))
            for key, grad in g.items():
                sums[key] += grad ** 2
                getattr(model, key)[...] -= rate * grad / np.sqrt(sums[key])
        owner = np.repeat(np.arange(known), lex.n)
        rows, spot = np.unique(np.append(lex.ids, ROWS), return_inverse=True)
        grad = np.zeros((len(rows), WIDTH), np.float32)
        _add_rows(grad, spot, np.concatenate([(learnt[:known] / np.sqrt(np.maximum(lex.n, 1))[:, None])[owner], learnt[known][None]]))
        sums["emb"][rows] += grad ** 2
        model.emb[rows] -= rate * grad / np.sqrt(sums["emb"][rows])
    return model


def _add_rows(out: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    # short numbers are sorted by their digits
    o = np.argsort(index.astype(np.uint16) if len(out) <= 1 << 16 else index, kind="stable")
    i = index[o]
    head = np.flatnonzero(np.diff(i, prepend=-1))
    if len(head):
        out[i[head]] += np.add.reduceat(values[o], head)


def _sum_rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    o = np.argsort(index, kind="stable")
    i = index[o]
    head = np.flatnonzero(np.diff(i, prepend=-1))
    if len(head):
        out[i[head]] = np.add.reduceat(values[o], head)
    return out


#: Buckets whose contexts go to one group.
_BUCKETS_A_PART = 128


def _contexts(batches_):
    """Of a task's texts: by part, the cells that are not zero and their counts."""
    ctx = None
    for batch in batches_:
        for part in slices(batch, "text"):
            words = Words.of(part.column("text"))
            got = contexts(words.text_of_word(), buckets_of(words, np.arange(len(words))))
            ctx = got if ctx is None else np.add(ctx, got, out=ctx)
    if ctx is not None:
        rows = ctx.reshape(BUCKETS // _BUCKETS_A_PART, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows)), pa.int32()), pa.array([pack(np.flatnonzero(x).astype(np.int32)) for x in rows], pa.binary()),
             pa.array([pack(x[x > 0]) for x in rows], pa.binary())], names=["part", "cells", "counts"])


def _contexts_added(t: pa.Table) -> pa.Table:
    total = np.zeros(_BUCKETS_A_PART * DIMS, np.int64)
    for cells, counts in zip(t.column("cells"), t.column("counts")):
        total[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(counts.as_buffer(), np.int64)
    some = np.flatnonzero(total)
    return pa.table({"part": t.column("part")[:1], "cells": pa.array([pack(some.astype(np.int32))], pa.binary()),
                     "counts": pa.array([pack(total[some])], pa.binary())})


def all_contexts(rows: DataFrame) -> np.ndarray:
    """``contexts`` of all texts, a matrix of fixed size."""
    schema = "part int, cells binary, counts binary"
    told = rows.select("text").mapInArrow(lambda b: _contexts(b), schema)
    half = told.withColumn("half", F.pmod(F.xxhash64("cells", "counts"), F.lit(64)).cast("int"))
    once = half.groupBy("part", "half").applyInArrow(lambda t: _contexts_added(t), schema)
    out = np.zeros((BUCKETS // _BUCKETS_A_PART, _BUCKETS_A_PART * DIMS), np.int64)
    for r in once.groupBy("part").applyInArrow(lambda t: _contexts_added(t), schema).collect():
        out[r["part"], np.frombuffer(bytes(r["cells"]), np.int32)] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(BUCKETS, DIMS)


def _first_model(classes: np.ndarray, path: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("text", "ascending")])
        model = train_on(Model.fresh(classes), list(slices(t, "text", 1 << 19)), path, epochs=2, rate=0.05)
        return pa.table({"model": pa.array([model.to_bytes()], pa.binary())})
    return run


def _refined(shared, path: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("text", "ascending")])
        flat = refine_on(Model.from_bytes(shared.value), t, path, 0.01).flat()
        size = 1 << 14
        k = -(-len(flat) // size)
        return pa.table({"part": pa.array(np.arange(k), pa.int32()), "block": pa.array(np.full(k, t.column("block")[0].as_py()), pa.int32()),
                         "n": pa.array(np.full(k, t.num_rows), pa.int64()),
                         "total": pa.array([pack(flat[i * size:(i + 1) * size].astype(np.float64) * t.num_rows) for i in range(k)], pa.binary())})
    return run


def _added(t: pa.Table) -> pa.Table:
    """Sums of weights, in the order of their blocks, so that a rerun rounds alike."""
    t = t.sort_by("block")
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("total"))
    n = int(sum(t.column("n").to_pylist()))
    return pa.table({"part": t.column("part")[:1], "block": t.column("block")[:1], "n": pa.array([n], pa.int64()),
                     "total": pa.array([pack(total)], pa.binary())})


def refined(rows: DataFrame, shared, path: str, blocks: int | None = None) -> DataFrame:
    """By part of the weights: sums over all texts ``(text)``, each block's weights as often as
    it holds texts.  Rows are dealt to blocks by the hash of all their columns (an id keeps
    copies of a text apart) and read in the order of their texts, so how the table is
    split plays no part."""
    schema = "part int, block int, n long, total binary"
    blocks = blocks or blocks_for(rows, "text", TRAIN_BYTES)
    dealt = rows.select("text", F.xxhash64("text", F.lit(4)).alias("h"),
                        F.pmod(F.xxhash64(*rows.columns, F.lit(6)), F.lit(blocks)).cast("int").alias("block"))
    told = dealt.groupBy("block").applyInArrow(lambda t: _refined(shared, path)(t), schema)
    half = told.withColumn("half", F.pmod("block", F.lit(64)).cast("int"))
    once = half.groupBy("part", "half").applyInArrow(lambda t: _added(t), schema)
    return once.groupBy("part").applyInArrow(lambda t: _added(t), schema).orderBy("part")


def train(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, blocks: int | None = None) -> bytes | None:
    """The model from training rows ``(text)`` (with an id: ``(id, text)``); None without any."""
    texts = docs.where("text is not null")
    rows = texts.select("text").withColumn("h", F.xxhash64("text", F.lit(4)))
    n = rows.count()
    if not n:
        return None
    classes = cluster(all_contexts(rows))
    part = F.pmod("h", F.lit(1 << 30))
    # each text once: a text with many copies does not fill the sample
    first = rows.where(part < min(1.0, sample / n) * (1 << 30)).groupBy("h").agg(F.min("text").alias("text")) \
        .withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_first_model(classes, path), "model binary").first()
    if first is None:
        first = rows.orderBy("h", "text").limit(1).withColumn("one", F.lit(0)).groupBy("one") \
            .applyInArrow(_first_model(classes, path), "model binary").first()
    model = Model.from_bytes(bytes(first["model"]))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(first["model"]))  # a fixed size
    mean = refined(texts, shared, path, blocks).collect()  # the model's size
    if mean:
        model = model.with_flat(np.concatenate([(np.frombuffer(bytes(r["total"])) / r["n"]).astype(np.float32) for r in mean]))
    return model.to_bytes()


def _sharded(hashes: np.ndarray, shards: int):
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    o = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[o], prepend=-1, append=-1)) if len(o) else np.zeros(1, np.int64)
    return shard, o, edge


def _count(shared, shards: int):
    """Training counts of this task's words, told to their shards a block of text at a time."""
    def flush(parts):
        h, n, c = (np.concatenate(x) for x in zip(*parts))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        n, c = np.bincount(inv, n).astype(np.int64), c[at]
        shard, o, edge = _sharded(u, shards)
        pieces = [o[a:b] for a, b in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(shard[p[0]]) for p in pieces], pa.int32()), pa.array([pack(u[p]) for p in pieces], pa.binary()),
             pa.array([pack(n[p]) for p in pieces], pa.binary()), pa.array([pack(c[p].astype(np.uint8)) for p in pieces], pa.binary())],
            names=["shard", "words", "counts", "classes"])

    def run(batches_):
        classes = Model.from_bytes(shared.value).classes if shared.value else np.zeros(BUCKETS, np.int16)
        parts, held = [], 0
        for batch in batches_:
            for part in slices(batch, "text"):
                words = Words.of(part.column("text"))
                if len(words):
                    u, at, n = np.unique(words.hashes(lower=True), return_index=True, return_counts=True)
                    parts.append((u, n, classes[buckets_of(words, at).astype(np.int64)]))
                held += len(words.data)
                if held > BLOCK_BYTES and parts:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)
    return run


def _lexicon(t: pa.Table) -> pa.Table:
    h, n, c = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(col)])
               for col, k in (("words", np.uint64), ("counts", np.int64), ("classes", np.uint8)))
    u, at, inv = np.unique(h, return_index=True, return_inverse=True)
    n, c = np.bincount(inv, n).astype(np.int64), c[at]
    return pa.table({"lex": t.column("shard")[:1], "known": pa.array([pack(u)], pa.binary()), "counts": pa.array([pack(n)], pa.binary()),
                     "n_class": pa.array([np.bincount(c, n, CLASSES).astype(np.int64)], pa.list_(pa.int64())),
                     "v_class": pa.array([np.bincount(c, minlength=CLASSES).astype(np.int64)], pa.list_(pa.int64()))})


def _ask(shards: int):
    def run(t: pa.Table) -> pa.Table:
        found = [np.unique(Words.of(p.column("text")).hashes(lower=True)) for p in slices(t, "text")]
        u = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        shard, o, edge = _sharded(u, shards)
        pieces = [o[a:b] for a, b in zip(edge, edge[1:])]
        block = t.column("block")[0].as_py() if t.num_rows else 0
        return pa.table({"shard": pa.array([int(shard[p[0]]) for p in pieces], pa.int32()),
                         "asker": pa.array([block] * len(pieces), pa.int32()),
                         "words": pa.array([pack(u[p]) for p in pieces], pa.binary())})
    return run


def _answer(asked: pa.Table, lex: pa.Table) -> pa.Table:
    known, counts = (np.frombuffer(lex.column(c)[0].as_buffer(), k) for c, k in (("known", np.uint64), ("counts", np.int64))) \
        if lex.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = []
    for x in asked.column("words"):
        h = np.frombuffer(x.as_buffer(), np.uint64)
        c = np.zeros(len(h), np.int64)
        if len(known):
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h
            c[hit] = counts[at[hit]]
        out.append(pack(c))
    return pa.table({"to": asked.column("asker"), "asked": asked.column("words"), "counts": pa.array(out, pa.binary())})


def _score(shared, path: str, facts: dict):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        # one order of rows, so that a rerun multiplies the same batches
        t = t.sort_by([("id", "ascending"), ("text", "ascending")])
        h = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(x.as_buffer(), np.uint64) for x in answers.column("asked")])
        c = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x.as_buffer(), np.int64) for x in answers.column("counts")])
        o = np.argsort(h)
        h, c = h[o], c[o]
        model = Model.from_bytes(shared.value) if shared.value else Model.fresh(np.zeros(BUCKETS, np.int16))
        mask = model.mask()
        ends, whole = facts["ends"], np.log10(facts["n"] + 0.5 * (facts["v"] + 1))
        room = np.log10(np.array(facts["n_class"]) + 0.5 * (np.array(facts["v_class"]) + 1))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        # of every word of the block, in the order of h: counts, class and vector, the
        # latter two when the word is met first; then those of the begin and of padding
        own, class_, met = np.log10(c + 0.5), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        vec = np.zeros((len(h) + 2, WIDTH), np.float32)
        vec[-2] = model.emb[ROWS]
        for part in slices(t, "text"):
            words = Words.of(part.column("text"))
            code = np.searchsorted(h, words.hashes(lower=True))
            new = np.flatnonzero(~met[code])
            fresh, at = np.unique(code[new], return_index=True)
            at = new[at]
            met[fresh] = True
            class_[fresh] = model.classes[buckets_of(words, at).astype(np.int64)]
            vec[fresh] = model.vectors(*subwords(words, at, path))
            n = words.counts
            full = np.flatnonzero(n)

            def per(a):
                total = np.zeros(len(n))
                if len(full):
                    total[full] = np.add.reduceat(a[code], words.first[:-1][full])
                return total

            out["n_tokens"].append(n + 1)
            out["n_known"].append(np.rint(per((c > 0).astype(float))).astype(np.int64) + int(ends > 0))
            out["base_score"].append(per(own) + np.log10(ends + 0.5) - (n + 1) * whole)
            score = per(own - room[class_])
            target = np.append(class_[code], END)
            for text, x, word, scored, end in batches(words.first, code, len(h)):
                pick = np.where(end, END, target[np.minimum(word, len(target) - 1)])
                rows, got = model.target_logs(vec[x], pick, scored, mask)
                np.add.at(score, text[rows // CONTEXT], got.astype(np.float64) / np.log(10))
            out["score"].append(score)
        cat = lambda k, kind: pa.array(np.concatenate(out[k]) if out[k] else [], kind)
        return pa.table({"id": t.column("id"), "held_out": t.column("held_out"), "n_tokens": cat("n_tokens", pa.int64()),
                         "n_known": cat("n_known", pa.int64()), "base_score": cat("base_score", pa.float64()),
                         "score": cat("score", pa.float64())})
    return run


def held_out(id_col: str, folds: int = 5, fold: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    shards = blocks_for(rows, "text")
    raw = train(training.select("id", "text"), path, blocks=-(-shards * BLOCK_BYTES // TRAIN_BYTES))
    shared = spark.sparkContext.broadcast(raw)
    lexicon = store(training.select("text").mapInArrow(
        _count(shared, shards), "shard int, words binary, counts binary, classes binary").groupBy("shard").applyInArrow(
        lambda t: _lexicon(t), "lex int, known binary, counts binary, n_class array<long>, v_class array<long>"))
    ends = training.count()
    sums = lexicon.select(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("n_class", "v_class") for i in range(CLASSES)]).first()
    facts = {c: [sums[f"{c}{i}"] or 0 for i in range(CLASSES)] for c in ("n_class", "v_class")}
    facts |= {"ends": ends, "n": sum(facts["n_class"]) + ends, "v": sum(facts["v_class"]) + (ends > 0)}
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")).groupBy("block")
    asked = blocks.applyInArrow(_ask(shards), "shard int, asker int, words binary")
    answers = asked.groupBy("shard").cogroup(lexicon.groupBy("lex")).applyInArrow(
        lambda a, b: _answer(a, b), "to int, asked binary, counts binary")
    return blocks.cogroup(answers.groupBy("to")).applyInArrow(
        _score(shared, path, facts), _SCORED.format(docs.schema[id_col].dataType.simpleString())) \
        .select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                F.lit(facts["n"]).cast("long").alias("train_tokens"), "base_score", "score")


_SCORED = "id {}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def op2_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
