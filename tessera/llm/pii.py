"""Personal data: base patterns and a skip-chain conditional random field.

The patterns find well-formed e-mail addresses, IP addresses, card numbers and
telephone numbers.  The field then labels every word that holds a digit or an
``@`` (all others are fixed to "none") and adds what the patterns miss.  Its
factors are

* what a word and its neighbours look like (hashed shapes, digit counts, whether
  a checksum or an address range holds), a softmax regression,
* the labels of adjacent words, and
* skip links between distant words of one document that repeat each other, or
  are alike: the same last seven digits, or the same name before an ``@``.

Repeats are linked in a chain from one to the next, and each to the nearest word
in a base span that it repeats, never all with all.  Sum-product messages pass over
all links until they settle: only messages whose inputs still change are computed
again, and the bound on the rounds grows with the longest text, so a label reaches
the end of any chain.  So a number that is clear in one place carries its label to
the places where only part of it or another spelling stands, however many.

The field learns from the patterns' own spans on at most ``sample`` documents
that hold a digit or an ``@``; the link factors are the log odds of the labels
that meet there.  Null and empty texts have no span; ids are carried along,
null or repeated; without a training document nothing is added.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SURE = 4000, 0.9
#: Messages that change by less have settled; rounds at most, besides some for each word of the longest text.
SETTLED, ROUNDS, ROUNDS_PER_WORD = 1e-4, 60, 4
FEATURES = 1 << 13

# The patterns; each starts where no shorter search could start it, so that a long
# run of one character is looked at once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            s = at
            while s > done and text[s - 1] in _LOCAL_BYTES:
                s -= 1
            if s < at:
                out.append((0, s, m.end()))
                done = m.end()
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Tokens:
    """The words of one text that hold a digit or an ``@``: code-point spans,
    word numbers, and hashed features."""

    def __init__(self, spans, number, text):
        self.spans, self.number, self.text = spans, number, text
        words = [text[a:b] for a, b in spans]
        self.words = words
        cores = [_core(w) for w in words]
        self.cores = [(a + i, a + j) for (a, _), (i, j) in zip(spans, cores)]
        shapes = [_shape(w[i:j]) for w, (i, j) in zip(words, cores)]
        rows = []
        for k, w in enumerate(words):
            near = lambda d: shapes[k + d] if 0 <= k + d < len(words) and number[k + d] == number[k] + d else "-"
            digits = re.sub("[^0-9]", "", w)
            rows.append([hash_feature(x) for x in (
                "w" + shapes[k], "s" + re.sub(r"(.)\1+", r"\1", shapes[k]), "n%d" % min(len(digits), 20),
                "b" + near(-1), "a" + near(1), "p" + shapes[k] + near(-1), "q" + shapes[k] + near(1),
                "+%d" % w.startswith("+"), "@%d" % ("@" in w), ".%d" % min(w.count("."), 5),
                "l%d" % (16 <= len(digits) <= 19 and luhn(digits)),
                "o%d" % bool(re.fullmatch(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}", w[cores[k][0]:cores[k][1]])),
                "1")])
        self.features = np.array(rows, np.int64).reshape(len(words), -1)

    def keys(self) -> list[list[str]]:
        """By which each word is known when it is repeated."""
        out = []
        for w in self.words:
            keys = []
            digits = re.sub("[^0-9]", "", w)
            if len(digits) >= 7:
                keys.append("d" + digits[-7:])
            elif len(digits) >= 4:
                keys.append("w" + digits)
            i, j = _core(w)
            name = w[i:j].split("@")[0].lower()
            if len(name) >= 5 and re.search("[a-z]", name):
                keys.append("n" + name)
            out.append(keys)
        return out

    def skips(self, known: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Each word that repeats, or is like, an earlier one, with the last such; with
        ``known`` labels also each unknown word with the nearest known one it repeats."""
        groups: dict[str, list[int]] = {}
        for k, keys in enumerate(self.keys()):
            for key in keys:
                groups.setdefault(key, []).append(k)
        out = set()
        for group in groups.values():
            out.update(zip(group, group[1:]))
            if known is None or len(group) < 3:
                continue
            at = np.array(group)
            clear = at[known[at] > 0]
            rest = at[known[at] == 0]
            if len(clear) and len(rest):
                after = np.searchsorted(clear, rest)
                left, right = clear[np.maximum(after - 1, 0)], clear[np.minimum(after, len(clear) - 1)]
                near = np.where(np.abs(rest - left) <= np.abs(right - rest), left, right)
                out.update(zip(np.minimum(near, rest).tolist(), np.maximum(near, rest).tolist()))
        return sorted(out)


def hash_feature(x: str) -> int:
    h = 1469598103934665603
    for b in x.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) % FEATURES


def _core(w: str) -> tuple[int, int]:
    """Where a word's outer punctuation ends (a leading + stays)."""
    i, j = 0, len(w)
    while i < j and not (w[i].isalnum() or w[i] == "+"):
        i += 1
    while j > i and not w[j - 1].isalnum():
        j -= 1
    return (i, j) if i < j else (0, len(w))


def _shape(w: str) -> str:
    w = w[:40]
    return re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", w))


def tokens_of(column, at: list[int] | None = None) -> list[tuple[int, str, Tokens]]:
    """(row, text, tokens) of the texts that hold a digit or an ``@``."""
    words = Words.of(column)
    data = words.data
    mark = ((data >= 48) & (data <= 57)) | (data == 64)
    if not mark.any():
        return []
    upto = np.concatenate([[0], np.cumsum(mark)])
    some = np.flatnonzero(upto[words.end] > upto[words.start]) if len(words) else np.zeros(0, np.int64)
    row = np.searchsorted(words.first, some, "right") - 1
    point = None
    out = []
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else []
    for lo, hi in zip(edge[:-1], edge[1:]) if len(row) else []:
        r = int(row[lo])
        a, b = int(words.offsets[r]), int(words.offsets[r + 1])
        raw = data[a:b]
        text = raw.tobytes().decode()
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        pick = some[lo:hi]
        spans = list(zip(point[words.start[pick] - a].tolist(), point[words.end[pick] - a].tolist()))
        out.append((r, text, Tokens(spans, (pick - words.first[r]).tolist(), text)))
    return out


def labels_of(tok: Tokens, spans) -> np.ndarray:
    """0, or 1 + the kind of the span that a word lies in or touches."""
    out = np.zeros(len(tok.spans), np.int64)
    starts = np.array([a for a, _ in tok.spans])
    ends = np.array([b for _, b in tok.spans])
    for kind, s, e in reversed(spans):
        out[np.searchsorted(ends, s, "right"):np.searchsorted(starts, e, "left")] = kind + 1
    return out


class Field:
    L = len(KINDS) + 1

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def to_bytes(self) -> bytes:
        buf = io.BytesIO()
        np.savez_compressed(buf, unary=self.unary, chain=self.chain, skip=self.skip)
        return buf.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Field":
        z = np.load(io.BytesIO(raw))
        return cls(z["unary"], z["chain"], z["skip"])

    @classmethod
    def fit(cls, docs: list[tuple[Tokens, np.ndarray]], epochs: int = 8, rate: float = 0.2) -> "Field":
        """Piecewise: the softmax regression by Adagrad, link factors by counting."""
        x = np.concatenate([t.features for t, _ in docs])
        y = np.concatenate([l for _, l in docs])
        w = np.zeros((FEATURES, cls.L), np.float32)
        g2 = np.full_like(w, 1e-3)
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), 256):
                i = order[k:k + 256]
                z = w[x[i]].sum(1)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                u, inv = np.unique(x[i], return_inverse=True)
                g = np.zeros((len(u), cls.L), np.float32)
                np.add.at(g, inv.reshape(x[i].shape), p[:, None, :] / 16)
                g2[u] += g * g
                w[u] -= rate * g / np.sqrt(g2[u])
        chain, skip = np.ones((cls.L, cls.L)), np.ones((cls.L, cls.L))
        for t, l in docs:
            n = np.array(t.number)
            near = np.flatnonzero(n[1:] == n[:-1] + 1)
            np.add.at(chain, (l[near], l[near + 1]), 1)
            for a, b in t.skips():
                skip[l[a], l[b]] += 1
                skip[l[b], l[a]] += 1
        odds = lambda c: np.log(c / c.sum() / np.outer(c.sum(1), c.sum(0)) * c.sum() ** 2)
        return cls(w, odds(chain).clip(-3, 3), cls._like(odds(skip)))

    @staticmethod
    def _like(odds: np.ndarray) -> np.ndarray:
        """A repeated word has one label: agreement on a kind is worth its log odds and
        at least 4, "none" beside a kind is no evidence against the kind (the patterns,
        which gave the training labels, miss just such words)."""
        out = odds.clip(-4, 8)
        k = np.arange(1, len(out))
        out[k, k] = np.maximum(out[k, k], 4) + 4
        out[0, 1:] = out[1:, 0] = np.minimum(out[0, 1:], -4)
        return out

    def beliefs(self, docs: list[Tokens], known: list[np.ndarray]) -> list[np.ndarray]:
        """Label probabilities by message passing over all links of all texts at once.
        Words inside base spans (``known`` > 0) are observed."""
        if not docs:
            return []
        at = np.concatenate([[0], np.cumsum([len(t.spans) for t in docs])])
        phi = self.unary[np.concatenate([t.features for t in docs])].sum(1).astype(np.float64)
        phi -= phi.max(1, keepdims=True)
        fixed = np.concatenate(known)
        seen = np.flatnonzero(fixed)
        phi[seen] = -30
        phi[seen, fixed[seen]] = 0
        src, dst, kind = [], [], []
        for o, t, k in zip(at, docs, known):
            n = np.array(t.number)
            near = np.flatnonzero(n[1:] == n[:-1] + 1)
            skips = np.array(t.skips(k), np.int64).reshape(-1, 2)
            src += [o + near, o + skips[:, 0]]
            dst += [o + near + 1, o + skips[:, 1]]
            kind += [np.zeros(len(near), bool), np.ones(len(skips), bool)]
        src, dst, kind = np.concatenate(src), np.concatenate(dst), np.concatenate(kind)
        e = len(src)
        frm, to = np.concatenate([src, dst]), np.concatenate([dst, src])
        pair = np.empty((2 * e, self.L, self.L))
        pair[:e] = np.where(kind[:, None, None], self.skip, self.chain)
        pair[e:] = np.where(kind[:, None, None], self.skip.T, self.chain.T)
        msg = np.zeros((2 * e, self.L))
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        # only messages whose inputs changed, or that have not settled, are computed again
        order = np.argsort(frm, kind="stable")
        first = np.searchsorted(frm[order], np.arange(len(phi) + 1))
        total = phi.copy()
        active = np.arange(2 * e)
        for _ in range(ROUNDS + ROUNDS_PER_WORD * int(np.diff(at).max())):
            if not len(active):
                break
            z = (total[frm[active]] - msg[back[active]])[:, :, None] + pair[active]
            m = z.max(1)
            new = m + np.log(np.exp(z - m[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            step = new - msg[active]
            msg[active] += 0.5 * step
            np.add.at(total, to[active], 0.5 * step)
            moved = active[np.abs(step).max(1) >= SETTLED]
            node = np.unique(to[moved])
            count = first[node + 1] - first[node]
            ends = np.cumsum(count)
            out = order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[node] - (ends - count), count)]
            active = np.union1d(moved, out)
        total = phi.copy()
        np.add.at(total, to, msg)
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return [p[a:b] for a, b in zip(at, at[1:])]


def _enough(kind: int, s: str) -> bool:
    """What a span of a kind holds at least; single short numbers are never added."""
    digits = sum(c.isdigit() for c in s)
    return {0: len(s) >= 5, 1: digits >= 4, 2: digits >= 7, 3: digits >= 7}[kind]


def added_spans(tok: Tokens, p: np.ndarray, base) -> list[tuple[int, int, int]]:
    """Runs of adjacent words of one sure kind that touch no base span."""
    best = p.argmax(1)
    sure = (best > 0) & (p.max(1) >= SURE)
    free = labels_of(tok, base) == 0
    out, k = [], 0
    while k < len(best):
        j = k
        if sure[k] and free[k]:
            while j + 1 < len(best) and sure[j + 1] and free[j + 1] and best[j + 1] == best[k] \
                    and tok.number[j + 1] == tok.number[j] + 1:
                j += 1
            s, e = tok.cores[k][0], tok.cores[j][1]
            if _enough(int(best[k]) - 1, tok.text[s:e]):
                out.append((int(best[k]) - 1, s, e))
        k = j + 1
    return out


def _train(t: pa.Table) -> pa.Table:
    t = t.sort_by([("h", "ascending"), ("text", "ascending")])
    docs = []
    for part in slices(t, "text"):
        for _, text, tok in tokens_of(part.column("text")):
            docs.append((tok, labels_of(tok, base_spans(text))))
    return pa.table({"net": pa.array([Field.fit(docs).to_bytes()] if docs else [], pa.binary())})


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> bytes | None:
    """Fit on at most about ``sample`` documents with a digit or an ``@``, chosen by a hash of the text."""
    some = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")) \
        .withColumn("h", F.xxhash64("text", F.lit(9)))
    n = some.count()
    if not n:
        return None
    got = some.where(F.pmod("h", F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)) \
        .groupBy("h").agg(F.min("text").alias("text")).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _train(t), "net binary").first()
    return bytes(got["net"]) if got else None


def found(texts, field: Field | None):
    """(row, text, base spans, added spans) of the texts of a column that have any."""
    docs = tokens_of(texts)
    base = [base_spans(text) for _, text, _ in docs]
    if field is None:
        return [(r, text, b, []) for (r, text, _), b in zip(docs, base)]
    # without any base span or skip link the field still speaks by its word factors
    p = field.beliefs([t for _, _, t in docs], [labels_of(t, b) for (_, _, t), b in zip(docs, base)])
    return [(r, text, b, added_spans(t, q, b)) for (r, text, t), b, q in zip(docs, base, p)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def detect(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: counts and digest of the base spans, all spans, and how many were added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the layout

    def run(batches):
        field = Field.from_bytes(shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                counts = np.zeros((n, len(KINDS) + 1), np.int64)
                digest = [hashlib.sha256(b"").hexdigest()] * n
                spans = [""] * n
                for r, _, base, more in found(part.column(text), field):
                    for k, _, _ in base:
                        counts[r, k] += 1
                    counts[r, -1] = len(more)
                    digest[r] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[r] = _joined(base + more)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                     pa.array(digest), pa.array(spans), pa.array(counts[:, -1])],
                    names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = T.StructType([docs.schema[id_col], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                           T.StructField("n_added", T.LongType())])
    return docs.select(id_col, text).mapInArrow(run, schema)


def masked_text(text: str, spans) -> str:
    """``text`` with every span, or overlapping spans as one, replaced by its kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: bytes | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked (``length``: a column that follows the new text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        field = Field.from_bytes(shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, text):
                new = part.column(text).to_pylist()
                hit = {}
                for r, whole, base, more in found(part.column(text), field):
                    if base or more:
                        hit[r] = new[r] = masked_text(whole, base + more)
                out = part.set_column(part.schema.get_field_index(text), text, pa.array(new, part.schema.field(text).type))
                if length and hit and length in part.schema.names:
                    n = out.column(length).to_pylist()
                    for r, t in hit.items():
                        n[r] = len(t)
                    i = part.schema.get_field_index(length)
                    out = out.set_column(i, length, pa.array(n, part.schema.field(length).type))
                yield out

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
