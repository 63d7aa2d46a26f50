import random

import numpy as np
import pyarrow as pa

from tessera.llm import licenses


def test_families_spans_and_unknown(spark):
    r = random.Random(1)
    lexicon = [f"u{i}" for i in range(600)] + ["the", "of", "license", "version", "software", "public"]
    filler = lambda n: " ".join(r.choice(lexicon) for _ in range(n))
    rows, want = [], {}
    i = 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            rows.append((i, filler(30) + "\n" + t + "\n" + filler(80), 1))
            rows.append((i + 1, "é " + filler(150) + " " + t + " " + filler(100), 1))  # inside a long line
            want[i] = want[i + 1] = family
            i += 2
    clean = [(1000 + k, "\n".join(filler(r.randint(1, 120)) for _ in range(4)), 1) for k in range(200)]
    clean += [(1300, "the license of this software is not public", 1), (1301, None, 1), (1302, "", 1), (None, "x", 1), clean[0], (1303, "u1 " * 30000, 1)]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string, spans int")
    got = licenses.scan(df, licenses.train(df)).collect()
    assert len(got) == len(rows) + len(clean)
    text = {i: t for i, t, _ in rows}
    right = 0
    for x in got:
        if x.doc_id not in want:
            assert x.families == "" and x.n_licences == 0, x
            continue
        right += x.families == want[x.doc_id]
        for s in filter(None, x.spans.split(",")):
            f, a, b = s.split(":")
            part = text[x.doc_id][int(a):int(b)]
            assert any(part.lower().strip(".") in t.lower() or t.lower().strip(".") in part.lower() or part[:12].lower() in t.lower() for t in licenses.TEMPLATES[f]), part
    assert right >= 0.97 * len(want), right / len(want)


def test_wrapped_notices(spark):
    """Every notice at 72 columns, plain and as a comment, among other lines and paragraphs."""
    import textwrap
    r = random.Random(3)
    filler = lambda n: " ".join(f"u{r.randrange(600)}" for _ in range(n))
    rows, want, i = [], {}, 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            lines = textwrap.wrap(t, 72)
            for body in ("\n".join(lines), "\n".join(" * " + x for x in lines), "\r\n".join("# " + x for x in lines)):
                rows.append((i, "Copyright 2020 A. Nyone\n\n" + body + "\n\n" + textwrap.fill(filler(60), 72)))
                want[i] = family, t, len(lines)
                i += 1
    twice = "Licensed under the MIT License.\nLicensed under the MIT License.\n" + filler(9)
    clean = [(1000 + k, textwrap.fill(filler(200), 72)) for k in range(100)]
    df = spark.createDataFrame(rows + clean + [(2000, twice)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df, licenses.train(df)).collect()}
    text = dict(rows)
    for i, (family, t, n) in want.items():
        assert got[i].families == family, (t, got[i])
        shorter = any(o != t and o.rstrip(".") in t for o in licenses.TEMPLATES[family])
        if n > 1 and not shorter:  # the span reaches over the lines
            a, b = (int(x) for x in got[i].spans.split(",")[0].split(":")[1:])
            assert text[i][a:b].count("\n") == n - 1, (t, got[i])
    assert all(got[k].families == "" for k, _ in clean) and got[2000].n_licences == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(df, licenses.train(df)).count() == 0


def test_pieces_of_one_word_at_the_end():
    """A slice may end with lines of fewer words than a gram has."""
    r = np.random.default_rng(4)
    net = licenses.Classifier(r.normal(size=(licenses.ROWS, licenses.UNKNOWN + 1)).astype(np.float32), np.zeros(licenses.UNKNOWN + 1))
    for text in ("one", "one\ntwo", "one\n\ntwo\n\nthree", "a b c d e\n\nf g\n\nh", " ".join("abcdefgh" * 3) + "\n\nend\n"):
        p = licenses.Paragraphs(pa.array([text]))
        got = net.logits(p.hashes, p.begin, p.end)
        for z, a, b in zip(got, p.begin, p.end):
            rows = np.concatenate(licenses.gram_rows(p.hashes[a:b]))
            assert np.allclose(z, net.weights[rows].astype(float).sum(0) / np.sqrt(max(1, len(rows))))
        net.families(p)
