"""Licence scans: a paragraph classifier confirmed by template comparison.

A paragraph is a line; a line of more than 16 words is read as overlapping pieces
of 16 words, half a piece apart, so a notice inside a long line is not drowned.  Lines
without a line of no words between them (a block) are also read as one such line, so
a notice wrapped over several lines is whole.  A piece's hashed word one-, two- and three-grams (letters and digits, A-Z lowered) enter a
multinomial logistic regression over the licence families and "unknown".

Training paragraphs are made from the templates below (cut, with words dropped and
foreign words around them) and, for "unknown", from at most ``sample`` documents'
paragraphs that share no run of four words with a template.  A quarter is kept back
to fit the temperature of the probabilities and the probability from which at most
0.1 % of unknown paragraphs are taken for a licence; below it a paragraph is unknown.

A predicted family is confirmed against its templates: the piece's line or block, as
far as twice the longest template reaches around the piece, must hold enough of one
template's three-grams; the span reported runs from the first to the last of them.
Of overlapping spans the one that holds most of its template stays; a block's span
over several lines that each hold the template gives way to theirs.

Inputs and results: null and empty texts have no paragraph and no licence; ids are
carried along, null or repeated; an empty table gives an empty one, and without any
document "unknown" is learned from made-up paragraphs of template words only.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, grams, slices, table

#: Notices by licence family.
TEMPLATES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License, version 2.0."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
ROWS, PIECE, HOLDS, SAMPLE = 1 << 15, 16, 0.6, 1500
_GAP = np.zeros(256, bool)
_GAP[:128] = [not chr(c).isalnum() for c in range(128)]


class Paragraphs:
    """Pieces of the lines, and of the blocks of several lines (``wide``), of some texts,
    by place: word ranges ``begin``/``end``, text, and the words of the line or block."""

    def __init__(self, column):
        self.words = w = Words.of(column, _GAP)
        self.hashes = w.hashes(lower=True)
        lines = np.concatenate([[0], np.cumsum(w.data == 10)])
        line = lines[w.start]  # a text's end also ends a line
        text = w.text_of_word()
        n = len(line)
        other = text[1:] != text[:-1]
        step = line[1:] - line[:-1]
        head = np.flatnonzero(np.concatenate([[True], (step > 0) | other])) if n else np.zeros(0, np.int64)
        block = np.flatnonzero(np.concatenate([[True], (step > 1) | other])) if n else np.zeros(0, np.int64)
        several = np.diff(np.searchsorted(head, np.append(block, n))) > 1
        narrow = _pieces(head, np.diff(np.append(head, n)))
        wide = _pieces(block[several], np.diff(np.append(block, n))[several])
        begin, end, lo, hi = (np.concatenate(x) for x in zip(narrow, wide))
        o = np.argsort(begin, kind="stable")
        self.begin, self.end, self.around = begin[o], end[o], (lo[o], hi[o])
        self.wide = o >= len(narrow[0])
        self.text = text[self.begin] if len(self.begin) else np.zeros(0, np.int64)


def _pieces(head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of the pieces of some ranges, and the range of each."""
    more = np.maximum(0, -(-(size - PIECE) // (PIECE // 2)))
    first = np.repeat(head, more + 1)
    last = np.repeat(head + size, more + 1)
    k = np.arange(len(first)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    begin = first + k * (PIECE // 2)
    return begin, np.minimum(begin + PIECE, last), first, last


def _rows(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(ROWS)


def gram_rows(hashes: np.ndarray) -> list[np.ndarray]:
    return [_rows(grams(hashes, n)).astype(np.int64) for n in (1, 2, 3)]


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, heat: float = 1.0, cut: float = 0.5):
        self.weights, self.bias, self.heat, self.cut = weights, bias, float(heat), float(cut)

    def to_bytes(self) -> bytes:
        buf = io.BytesIO()
        np.savez_compressed(buf, w=self.weights, b=self.bias, s=np.array([self.heat, self.cut]))
        return buf.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Classifier":
        z = np.load(io.BytesIO(raw))
        return cls(z["w"], z["b"], *z["s"])

    def logits(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the pieces ``hashes[begin:end]``: prefix sums of the grams' weights."""
        out = np.zeros((len(begin), len(self.bias)))
        total = np.zeros(len(begin))
        for n, rows in enumerate(gram_rows(hashes), 1):
            upto = np.zeros((len(rows) + 1, len(self.bias)))
            np.cumsum(self.weights[rows], axis=0, out=upto[1:], dtype=np.float64)
            # a piece of fewer words than `n` has no gram, also where it is the last
            start = np.minimum(begin, len(rows))
            stop = np.maximum(start, np.minimum(end - n + 1, len(rows)))
            out += upto[stop] - upto[start]
            total += stop - start
        return out / np.sqrt(np.maximum(total, 1))[:, None] + self.bias

    def families(self, p: Paragraphs) -> tuple[np.ndarray, np.ndarray]:
        """Pieces whose family is known, and it."""
        found, family = [], []
        for k in range(0, len(p.begin), 1 << 13):
            a, b = p.begin[k:k + (1 << 13)], p.end[k:k + (1 << 13)]
            lo, hi = int(a.min()), int(b.max())
            z = self.logits(p.hashes[lo:hi], a - lo, b - lo) / self.heat
            best = z.argmax(1)
            sure = np.exp(z.max(1) - z.max(1)) / np.exp(z - z.max(1, keepdims=True)).sum(1)
            hit = np.flatnonzero((best != UNKNOWN) & (sure >= self.cut))
            found.append(k + hit)
            family.append(best[hit])
        return (np.concatenate(found), np.concatenate(family)) if found else (np.zeros(0, np.int64),) * 2


def _hashes(text: str) -> np.ndarray:
    return Words.of(pa.array([text]), _GAP).hashes(lower=True)


def template_grams() -> list[list[np.ndarray]]:
    return [[grams(_hashes(t), min(3, len(_hashes(t)))) for t in TEMPLATES[f]] for f in FAMILIES]


def confirm(hashes: np.ndarray, begin: int, end: int, family: int, templates) -> tuple[float, int, int, int] | None:
    """Share and word range of the family's best template in a range, if enough of it is
    there, and which template."""
    own = grams(hashes[begin:end], 3)
    best, span = 0.0, None
    for k, t in enumerate(templates[family]):
        here = np.flatnonzero(np.isin(own, t))
        share = len(np.unique(own[here])) / max(1, len(np.unique(t)))
        if len(here) and share >= HOLDS and share > best:
            best, span = share, (share, begin + int(here[0]), begin + int(here[-1]) + 3, k)
    return span


def without_runs(narrow: list[tuple], wide: list[tuple]) -> list[tuple]:
    """``(share, begin, end, template, family)`` of the blocks, without those that run
    over several lines' spans of their own template."""
    return [h for h in set(wide) if len({x[1] for x in narrow if x[3:] == h[3:] and h[1] <= x[1] and x[2] <= h[2]}) < 2]


def best_spans(hits: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping hits ``(share, begin, end, family)`` that of the largest share,
    then the longest, then the first by place and name."""
    out: list[tuple[int, int, int]] = []
    for _, a, b, f in sorted(set(hits), key=lambda h: (-h[0], h[1] - h[2], h[1], h[3])):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, f))
    return sorted(out)


def fit(foreign: list[np.ndarray], epochs: int = 12, rate: float = 0.5, copies: int = 120, seed: int = 13) -> Classifier:
    """From templates and ``foreign`` paragraphs (word hashes)."""
    r = np.random.default_rng(seed)
    templates = [[_hashes(t) for t in TEMPLATES[f]] for f in FAMILIES]
    fours = np.unique(np.concatenate([grams(t, 4) for f in templates for t in f]))
    foreign = [p for p in foreign if len(p) and not np.isin(grams(p, 4), fours).any()]
    every = np.unique(np.concatenate([t for f in templates for t in f]))
    foreign += [r.choice(every, r.integers(2, 30)) for _ in range(200)]  # licence words alone are no licence
    loose = np.concatenate(foreign)
    x, y = list(foreign), [UNKNOWN] * len(foreign)
    for k, family in enumerate(templates):
        for t in family:
            for c in range(copies):
                words = t[r.random(len(t)) > (0.08 if c % 3 == 1 else 0)]
                if len(words) > PIECE:
                    at = r.integers(0, len(words) - PIECE + 1)
                    words = words[at:at + PIECE]
                elif c % 2:
                    extra = r.integers(0, PIECE - len(words) + 1)
                    before = r.integers(0, extra + 1)
                    words = np.concatenate([r.choice(loose, before), words, r.choice(loose, extra - before)])
                x.append(words)
                y.append(k)
    y = np.array(y)
    rows = [np.concatenate(gram_rows(p)) for p in x]
    w = np.zeros((ROWS, UNKNOWN + 1), np.float32)
    g2 = np.full_like(w, 1e-3)
    bias = np.zeros(UNKNOWN + 1)
    kept = r.random(len(x)) < 0.25
    use = np.flatnonzero(~kept)
    for _ in range(epochs):
        for i in r.permutation(use):
            v = 1 / np.sqrt(max(1, len(rows[i])))
            z = w[rows[i]].sum(0) * v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            u = np.unique(rows[i])
            g = (p * v).astype(np.float32)
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            bias -= 0.01 * p
    out = Classifier(w, bias)
    held = np.flatnonzero(kept)
    z = np.concatenate([out.logits(x[i], np.array([0]), np.array([len(x[i])])) for i in held])

    def loss(heat):
        s = z / heat
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(held)), y[held]] - np.log(np.exp(s).sum(1))).mean()

    heats = np.geomspace(0.1, 10, 41)
    out.heat = float(heats[np.argmin([loss(h) for h in heats])])
    s = z / out.heat
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = np.sort(np.where(p.argmax(1) == UNKNOWN, 0, p.max(1))[y[held] == UNKNOWN])
    out.cut = float(max(0.5, best[min(len(best) - 1, int(np.ceil(len(best) * 0.999)))]) if len(best) else 0.5)
    out.cut = min(out.cut, 0.99)
    return out


def _train(t: pa.Table) -> pa.Table:
    t = t.sort_by([("h", "ascending"), ("text", "ascending")])
    foreign = []
    for part in slices(t, "text"):
        p = Paragraphs(part.column("text"))
        foreign += [p.hashes[a:b] for a, b in zip(p.begin, p.end)]
    r = np.random.default_rng(1)
    if len(foreign) > 8 * SAMPLE:
        foreign = [foreign[i] for i in np.sort(r.choice(len(foreign), 8 * SAMPLE, replace=False))]
    return pa.table({"net": pa.array([fit(foreign).to_bytes()], pa.binary())})


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> bytes:
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text")) \
        .withColumn("h", F.xxhash64("text", F.lit(21)))
    n = rows.count()
    got = rows.where(F.pmod("h", F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30)) \
        .groupBy("h").agg(F.min("text").alias("text")).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _train(t), "net binary").first()
    return bytes(got["net"]) if got else fit([]).to_bytes()


def scan(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``id_col, n_paragraphs`` (pieces of lines), ``n_licences, families`` (distinct, by
    name) and ``spans`` (``family:start:end`` in code points, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the layout

    def run(batches):
        net, templates = Classifier.from_bytes(shared.value), template_grams()
        reach = 2 + max(len(t) for f in templates for t in f)
        for batch in batches:
            for part in slices(batch, text):
                p = Paragraphs(part.column(text))
                found: dict[int, tuple[list, list]] = {}
                for piece, family in zip(*net.families(p)):
                    lo = max(int(p.around[0][piece]), int(p.begin[piece]) - reach)
                    hi = min(int(p.around[1][piece]), int(p.end[piece]) + reach)
                    got = confirm(p.hashes, lo, hi, int(family), templates)
                    if got:
                        found.setdefault(int(p.text[piece]), ([], []))[int(p.wide[piece])].append((*got, int(family)))
                spans, families, n = [""] * part.num_rows, [""] * part.num_rows, np.zeros(part.num_rows, np.int64)
                for r, (narrow, wide) in found.items():
                    raw = p.words.data[p.words.offsets[r]:p.words.offsets[r + 1]]
                    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    at = p.words.offsets[r]
                    merged = best_spans([(share, a, b, f) for share, a, b, _, f in narrow + without_runs(narrow, wide)])
                    spans[r] = ",".join(f"{FAMILIES[f]}:{point[p.words.start[a] - at]}:{point[p.words.end[b - 1] - at]}" for a, b, f in merged)
                    families[r] = ",".join(sorted({FAMILIES[f] for _, _, f in merged}))
                    n[r] = len(merged)
                count = np.bincount(p.text[~p.wide], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(count), pa.array(n), pa.array(families), pa.array(spans)],
                    names=[id_col, "n_paragraphs", "n_licences", "families", "spans"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_paragraphs", T.LongType()), T.StructField("n_licences", T.LongType()),
                           T.StructField("families", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(id_col, text).mapInArrow(run, schema)


def op4_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
