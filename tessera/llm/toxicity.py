"""Toxicity: a convolutional text classifier trained in numpy.

Each word (ASCII punctuation also ends a word here, A-Z are lowered) is three
hashed embeddings side by side: two of the whole word under different hashes,
so that two words seldom share both rows, and one of its first bytes, for stems
with unseen endings.  Filters of widths 1, 2 and 3 slide over the words, each
filter keeps its maximum over the whole text, and a logistic layer turns the
maxima into a score.  Gradients flow through the maxima only, so a training step
touches few rows.

The classifier is fitted on at most ``per_class`` labelled rows of each class,
chosen by a hash of the id and weighted back to the class sizes; a quarter of
them is kept back to fit the score's scale and, by language, the threshold at
which a document is rejected.  Language is no input of the score.

Inputs and results: null and empty texts have no words and get the score of the
bare bias; rows without a label, or with a null id or label, train nothing; of
repeated labels of one id the largest counts; without any labelled row of both
classes every score is the share of label 1 (0 if there is none) and nothing is
rejected.  Any other column is carried along untouched.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, table

#: Fixed layout of the model.
ROWS_WORD, ROWS_STEM, DIM, STEM_BYTES = 1 << 17, 1 << 16, 8, 4
WIDTHS, FILTERS = (1, 2, 3), 8
PER_CLASS = 4000

_GAP = np.zeros(256, bool)
_GAP[:128] = [not chr(c).isalnum() for c in range(128)]


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word (three columns) and each text's first word."""
    words = Words.of(column, _GAP)
    h = words.hashes(lower=True)
    s = words.hashes(lower=True, prefix=STEM_BYTES)
    rows = np.empty((len(h), 3), np.int64)
    rows[:, 0] = h % np.uint64(ROWS_WORD)
    rows[:, 1] = (h >> np.uint64(32)) % np.uint64(ROWS_WORD) + np.uint64(ROWS_WORD)
    rows[:, 2] = s % np.uint64(ROWS_STEM) + np.uint64(2 * ROWS_WORD)
    return rows, words.first


class Net:
    def __init__(self, table_, filters, filter_bias, out, out_bias, scale=1.0):
        self.table, self.filters, self.filter_bias = table_, filters, filter_bias
        self.out, self.out_bias, self.scale = out, float(out_bias), float(scale)

    @classmethod
    def fresh(cls, log_odds: np.ndarray, share: float, seed: int = 7) -> "Net":
        """Each row's first component starts as what its words say of the label,
        shrunk for few documents; unseen rows stay at zero and never pull."""
        rng = np.random.default_rng(seed)
        emb = np.zeros((2 * ROWS_WORD + ROWS_STEM, DIM), np.float32)
        emb[:, 0] = log_odds
        filters = [rng.normal(0, 0.1, (w, 3 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[0, [0, DIM, 2 * DIM], :] = np.abs(f[0, [0, DIM, 2 * DIM], :]) + 0.15
        return cls(emb, filters, np.full(FILTERS * len(WIDTHS), -1.0, np.float32),
                   rng.uniform(0.2, 0.4, FILTERS * len(WIDTHS)).astype(np.float32),
                   np.log(share / (1 - share)) - 1)

    def pooled(self, rows: np.ndarray, first: np.ndarray, where: bool = False):
        """Maxima of all filters by text, and (``where``) the words they start at."""
        n, texts = len(rows), len(first) - 1
        pad = max(WIDTHS) - 1
        start = first[:-1] + pad * np.arange(texts)
        size = np.diff(first)
        at = np.arange(n) + np.repeat(pad * np.arange(texts), size)
        x = np.zeros((n + pad * texts, 3 * DIM), np.float32)
        x[at] = self.table[rows].reshape(n, 3 * DIM)
        hidden = np.full(len(x), True)
        hidden[at] = False
        best, spots = [], []
        for w, f in zip(WIDTHS, self.filters):
            act = x @ f[0]
            for j in range(1, w):
                act[:-j] += x[j:] @ f[j]
            act[hidden] = -np.inf
            best.append(np.maximum.reduceat(act, start, axis=0) if texts else act[:0])
            if where:
                spots.append(np.array([s + act[s:s + k].argmax(0) if k else np.full(FILTERS, -1)
                                       for s, k in zip(start, size)]))
        best = np.concatenate(best, axis=1) if texts else np.zeros((0, FILTERS * len(WIDTHS)), np.float32)
        best[~np.isfinite(best)] = -1e9
        out = np.maximum(best + self.filter_bias, 0)
        return (out, x, at, spots) if where else out

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.pooled(rows, first) @ self.out + self.out_bias
        return z.astype(np.float64) * self.scale

    def to_bytes(self) -> bytes:
        used = np.flatnonzero(np.any(self.table != 0, axis=1)).astype(np.int32)
        buf = io.BytesIO()
        np.savez_compressed(buf, used=used, rows=self.table[used], bias=self.filter_bias, out=self.out,
                            rest=np.array([self.out_bias, self.scale]),
                            **{f"f{i}": f for i, f in enumerate(self.filters)})
        return buf.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Net":
        z = np.load(io.BytesIO(raw))
        emb = np.zeros((2 * ROWS_WORD + ROWS_STEM, DIM), np.float32)
        emb[z["used"]] = z["rows"]
        return cls(emb, [z[f"f{i}"] for i in range(len(WIDTHS))], z["bias"], z["out"], *z["rest"])


def _log_odds(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, prior: float = 20.0) -> np.ndarray:
    size = 2 * ROWS_WORD + ROWS_STEM
    seen = np.zeros((2, size))
    for rows, label, w in zip(docs, y, weight):
        seen[label, np.unique(rows)] += w
    share = (weight * y).sum() / weight.sum()
    return np.log((seen[1] + prior * share) / (seen[0] + prior * (1 - share)) * (1 - share) / share) \
        .clip(-6, 6).astype(np.float32)


def fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 4,
        batch: int = 32, rate: float = 0.02) -> Net:
    """Adagrad on the weighted logistic loss."""
    share = float((weight * y).sum() / weight.sum())
    net = Net.fresh(_log_odds(docs, y, weight), share)
    sums: dict = {}

    def step(key, value, grad, at=...):
        g2 = sums.setdefault(key, np.full(value.shape, 1e-3, np.float32))
        g2[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(g2[at])

    rng = np.random.default_rng(11)
    order = np.arange(len(docs))
    unit = weight / weight.mean()
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            rows = np.concatenate([docs[i] for i in part])
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in part])])
            top, x, at, spots = net.pooled(rows, first, where=True)
            z = top @ net.out + net.out_bias
            err = ((1 / (1 + np.exp(-z.clip(-30, 30))) - y[part]) * unit[part] / len(part)).astype(np.float32)
            back = err[:, None] * net.out * (top > 0)
            word_at = np.full(len(x), -1)
            word_at[at] = np.arange(len(at))
            g_rows, g_vals = [], []
            for i, w in enumerate(WIDTHS):
                d = back[:, i * FILTERS:(i + 1) * FILTERS]
                text, col = np.nonzero(d)
                if not len(text):
                    continue
                g, spot = d[text, col], spots[i][text, col]
                gf = np.zeros_like(net.filters[i])
                for j in range(w):
                    np.add.at(gf[j].T, col, g[:, None] * x[spot + j])
                    hit = word_at[spot + j] >= 0
                    g_rows.append(rows[word_at[spot + j][hit]])
                    g_vals.append((g[:, None] * net.filters[i][j].T[col])[hit].reshape(-1, 3, DIM))
                step(("f", i), net.filters[i], gf)
            step("b", net.filter_bias, back.sum(0))
            step("o", net.out, err @ top)
            net.out_bias -= rate * float(err.sum())
            if g_rows:
                r, v = np.concatenate(g_rows).ravel(), np.concatenate(g_vals).reshape(-1, DIM)
                u, inv = np.unique(r, return_inverse=True)
                total = np.zeros((len(u), DIM), np.float32)
                np.add.at(total, inv, v)
                step("e", net.table, total, u)
    return net


def _calibrate(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the label on the raw score (Newton, damped)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b).clip(-30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 1e-2 * (a - 1), (w * (p - y)).sum() + 1e-2 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0].clip(-1, 1), b - d[1].clip(-1, 1)
    return max(a, 0.05), b


def _threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray, least: int = 20) -> float:
    """The middle of the scores that err least (weighted); 0.5 with few rows of a class."""
    if y.sum() < least or (1 - y).sum() < least:
        return 0.5
    o = np.argsort(score, kind="stable")
    s, yy, ww = score[o], y[o], w[o]
    # cut before position i: errors are label 1 below it and label 0 from it on
    err = np.concatenate([[0], np.cumsum(ww * yy)]) + np.concatenate([np.cumsum((ww * (1 - yy))[::-1])[::-1], [0]])
    edge = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    tie = np.concatenate([[False], s[1:] == s[:-1], [False]])
    err[tie] = np.inf
    good = np.flatnonzero(err <= err.min() + 1e-9)
    return float(edge[good[np.argmin(np.abs(edge[good] - 0.5))]].clip(0.02, 0.98))


def _train(t: pa.Table) -> pa.Table:
    o = np.argsort(t.column("id").to_numpy(), kind="stable")
    t = t.take(pa.array(o))
    y = t.column("label").to_numpy().astype(np.int64)
    weight = t.column("weight").to_numpy().astype(np.float64)
    if min(y.sum(), (1 - y).sum()) == 0:
        return pa.table({"net": pa.array([], pa.binary()), "lang": pa.array([], pa.list_(pa.string())),
                         "cut": pa.array([], pa.list_(pa.float64()))})
    lang = np.array([x or "" for x in t.column("lang").to_pylist()], object)
    docs = []
    for part in slices(t, "text"):
        rows, first = features(part.column("text"))
        docs += [rows[a:b] for a, b in zip(first, first[1:])]
    kept = np.arange(len(y)) % 4 == 3
    if min(y[~kept].sum(), (1 - y[~kept]).sum()) == 0 or min(y[kept].sum(), (1 - y[kept]).sum()) == 0:
        kept = np.zeros(len(y), bool)
    use = np.flatnonzero(~kept)
    net = fit([docs[i] for i in use], y[use], weight[use])
    cal = np.flatnonzero(kept) if kept.any() else use
    z = np.concatenate([net.logits(docs[i], np.array([0, len(docs[i])])) for i in cal])
    a, b = _calibrate(z, y[cal], weight[cal])
    net.out, net.out_bias, net.scale = net.out, net.out_bias + b / a, a
    score = 1 / (1 + np.exp(-(a * z + b).clip(-30, 30)))
    cuts = {"": _threshold(score, y[cal], weight[cal])}
    for x in sorted(set(lang[cal])):
        m = lang[cal] == x
        if x and min(y[cal][m].sum(), (1 - y[cal][m]).sum()) >= 20:
            cuts[x] = _threshold(score[m], y[cal][m], weight[cal][m])
    return pa.table({"net": pa.array([net.to_bytes()], pa.binary()),
                     "lang": pa.array([list(cuts)], pa.list_(pa.string())),
                     "cut": pa.array([list(cuts.values())], pa.list_(pa.float64()))})


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          lang: str | None = "lang", per_class: int = PER_CLASS):
    """Fit on a bounded sample of labelled rows: ``(model bytes, {language: threshold})``,
    or ``(None, share of label 1)`` when a class has no row.  Labels of held-out ids are
    never used.  The sample is drawn among the labels, about ``per_class`` of each class,
    so it is small by construction and finds its texts by a broadcast."""
    own = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")) \
        .where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return None, float(n.get(1, 0) > 0)
    share = F.when(F.col("label") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    chosen = own.withColumn("share", share) \
        .where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(1 << 30)) < F.col("share") * (1 << 30)) \
        .select("id", "label", (1 / F.col("share")).alias("weight"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"),
                       (F.col(lang) if lang else F.lit("")).alias("lang"))
    sample = rows.join(F.broadcast(chosen), "id").groupBy(F.col("id").cast("string").alias("id"), "label", "weight") \
        .agg(F.min("text").alias("text"), F.min("lang").alias("lang")).withColumn("one", F.lit(0))
    got = sample.groupBy("one").applyInArrow(
        lambda t: _train(t), "net binary, lang array<string>, cut array<double>").first()
    if got is None:
        return None, n[1] / (n[0] + n[1])
    return bytes(got["net"]), dict(zip(got["lang"], got["cut"]))


def score(docs: DataFrame, model, text: str = "text", lang: str | None = "lang",
          score_col: str = "score", reject_col: str = "rejected") -> DataFrame:
    """``docs`` with the score of every whole text and whether its language's
    threshold (that of all languages for others) rejects it."""
    raw, cuts = model
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (score_col, reject_col)]
                          + [T.StructField(score_col, T.DoubleType()), T.StructField(reject_col, T.BooleanType())])
    if raw is None:
        return docs.withColumn(score_col, F.lit(float(cuts))).withColumn(reject_col, F.lit(False)) \
            .select(*[f.name for f in schema.fields])
    shared = docs.sparkSession.sparkContext.broadcast(raw)  # its size is fixed by the layout above
    carried = [f.name for f in schema.fields[:-2]]

    def run(batches):
        net = Net.from_bytes(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                z = net.logits(*features(part.column(text)))
                s = 1 / (1 + np.exp(-z.clip(-30, 30)))
                langs = part.column(lang).to_pylist() if lang else [None] * len(s)
                cut = np.array([cuts.get(x, cuts[""]) for x in langs])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried]
                                                 + [pa.array(s), pa.array(s >= cut)], names=carried + [score_col, reject_col])

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "lang", "text"), model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
