import hashlib
import re

import pytest

from tessera.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The patterns as they are written, one search after the other."""
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


CASES = ["a.b@c.de x@y @z.q a@b a@b.c@d.e.f", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 00001.2.3.4 1.2.3.4567 9.9.9.9.9",
         "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111 1 2", "+1 (988) 555-2485 +12 +1+23456789 +1 ( 2",
         "é\U0001F600 x@y.z 10.0.0.1", "+4111111111111111 a+b@c.d", "", "@", "...", "1" * 3000, "1." * 2000, "a@" * 500 + "b.c", "+1" + " " * 500]


@pytest.mark.parametrize("text", CASES)
def test_base_is_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_random_strings():
    import random
    r = random.Random(0)
    for _ in range(3000):
        t = "".join(r.choice("a1.@+- (9é") for _ in range(r.randint(1, 40)))
        assert pii.base_spans(t) == plain(t), t


@pytest.fixture(scope="module")
def corpus(spark):
    import random
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = [r.choice(["alpha", "beta", "gamma", "section"]) for _ in range(30)]
        pick = ["+1 (%03d) 555-%04d" % (r.randrange(1000), r.randrange(10000)), "%s.%02d@mail%d.example.com" % (r.choice(["ann", "bo"]), r.randrange(99), r.randrange(9)),
                "10.%d.%d.%d" % tuple(r.randrange(256) for _ in range(3)), "4111 1111 1111 1111", "page %d" % r.randrange(9999), "v1.%d" % r.randrange(9)]
        w[10], w[20] = r.choice(pick), r.choice(pick)
        rows.append((i, " ".join(w)))
    return rows


def test_repeats_carry_their_label(spark, corpus):
    text = "Call +1 (456) 555-2186 now. Much later: 456-555-2186 or 555.2186? Page 1234 of 9876."
    rows = corpus + [(1000, text), (1001, "Page 1234 of 9876, 456-555-2186"), (1002, None), (1003, ""), (None, "x@y.z"), (1000, text)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_email int, spans string")
    got = [r for r in pii.detect(df, pii.train(df)).collect()]
    assert len(got) == len(rows)
    for r in (x for x in got if x.doc_id == 1000):
        spans = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(","))]
        assert ("phone", "+1 (456) 555-2186") in spans and ("phone", "456-555-2186") in spans
        assert not any("1234" in s or "9876" in s for _, s in spans) and r.n_phone == 1 and r.n_added >= 1
    by = {r.doc_id: r for r in got}
    assert by[1001].n_added == 0 and by[1002].spans == by[1003].spans == "" and by[None].n_email == 1
    texts = dict(corpus)
    for i, t in texts.items():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(t))
        assert by[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert by[i].spans == want  # nothing is added where nothing repeats


def test_many_repeats_all_carry_the_label(spark, corpus):
    repeats = " ".join("then 456-555-2186 or" for _ in range(50))
    rows = corpus + [(1000, "Call +1 (456) 555-2186 now. " + repeats), (1001, repeats + " call +1 (456) 555-2186")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in pii.mask(df, pii.train(df)).where("doc_id >= 1000").collect()}
    for text in got.values():
        assert "2186" not in text and text.count("[PHONE]") == 51


def test_messages_settle_along_a_long_chain():
    """Each word shares one key with the word before and another with the word after."""
    import numpy as np
    name = lambda k: "name" + chr(97 + k // 26) + chr(97 + k % 26)
    words = [f"{name((k + 1) // 2)}@{5550000 + k // 2}" for k in range(120)]
    spans, at = [], 0
    for w in words:
        spans.append((at, at + len(w)))
        at += len(w) + 3
    tok = pii.Tokens(spans, list(range(0, 240, 2)), " x ".join(words))
    same = np.full((5, 5), -4.0)
    np.fill_diagonal(same, 8)
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), same)
    known = np.zeros(120, np.int64)
    known[0] = 1
    p = field.beliefs([tok], [known])[0]
    assert (p[:, 1] > 0.9).all()


def test_mask(spark, corpus):
    rows = corpus[:50] + [(90, "x@y.z and +1 (456) 555-2186"), (91, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.mask(df, pii.train(df)).collect()}
    assert got[90].text == "[EMAIL] and [PHONE]" and got[90].n_chars == 19 and got[91].text is None


def test_empty_and_no_training(spark):
    df = spark.createDataFrame([(1, "no digits here")], "doc_id long, text string")
    assert pii.train(df) is None
    assert pii.detect(df, None).first().spans == "" and pii.detect(df.where("false"), None).count() == 0
