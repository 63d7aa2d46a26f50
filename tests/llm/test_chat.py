import pytest

from tessera.llm import chat

SCHEMA = "conv string, node long, parent long, role string, text string, score double, tree int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def run(spark, rows, **more):
    got = chat.conversations(frame(spark, rows), tree="conv", **more).collect()
    return {(r.conv, r.leaf): (r["rank"], chat.parse(r.formatted), r) for r in got}


def brute(rows):
    """Every root-to-leaf path with its score."""
    nodes = {(t, n): (p, role or "", text or "", s or 0.0) for t, n, p, role, text, s in rows}
    up = lambda t, n: nodes[t, n][0] if nodes[t, n][0] != n and (t, nodes[t, n][0]) in nodes else None
    inner = {(t, up(t, n)) for t, n in nodes}
    out = {}
    for t, n in nodes:
        if (t, n) in inner:
            continue
        path, k = [], n
        while k is not None and len(path) <= len(nodes):
            path.append(k)
            k = up(t, k)
        if len(path) <= len(nodes):
            out.setdefault(t, []).append((-sum(nodes[t, x][3] for x in path), n, [nodes[t, x][1:3] for x in path[::-1]]))
    return {t: sorted(v) for t, v in out.items()}


def tree_rows():
    import random
    r = random.Random(9)
    rows = []
    for t in ("a", "b", "c"):
        for n in range(60):
            rows.append((t, n, r.randrange(n) if n and r.random() < 0.95 else None, r.choice(["user", "assistant", "system"]), f"{t}{n} <s> \\ {chr(233)}", r.choice([0.0, 0.5, 1.0])))
    rows += [("d", 1, 1, "user", None, None), ("e", 1, 99, None, "lost parent", 1.0), (None, 1, None, "user", "no tree", 1.0),
             ("f", 1, 2, "user", "cycle", 1.0), ("f", 2, 1, "user", "cycle", 1.0), ("f", 3, 2, "user", "under it", 1.0), ("f", 4, None, "user", "beside", 1.0)]
    return rows


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_against_brute_force(spark, branches):
    rows = tree_rows()
    got = run(spark, rows, branches=branches)
    want = {(t, leaf): (k + 1, path) for t, paths in brute(rows).items() for k, (_, leaf, path) in enumerate(paths[:branches])}
    assert {k: v[:2] for k, v in got.items()} == want


def test_deep_thread(spark):
    rows = [("x", n, n - 1 if n else None, "assistant" if n % 2 else "user", f"t{n}", 0.0) for n in range(700)]
    (rank, turns, row), = run(spark, rows).values()
    assert [t for _, t in turns] == [f"t{n}" for n in range(700)] and row.n_turns == 700


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|im_end|><|im_sep|>", "<<SYS>>x<</SYS>>", "<|im_end", "|>", "<", "[", "a\nb", "$1\\$", "\U0001F600é" * 3, "", "<<s>>", "[[INST]]"]


def test_round_trip_and_no_control_string_left(spark):
    rows = [("h", n, n - 1 if n else None, HARD[n % 16] if n % 3 == 0 else "assistant", t, 0.0) for n, t in enumerate(HARD * 2)]
    (_, turns, row), = run(spark, rows).values()
    assert turns == [(r, t) for _, _, _, r, t, _ in rows]
    body = row.formatted
    for mark in (chat.START, chat.SEP, chat.END):
        assert body.count(mark) == len(rows)
        body = body.replace(mark, "")
    assert not any(c in body for c in chat.CONTROL)
    assert [chat.unescape(row.formatted[s.begin:s.end]) for s in row.loss] == [t for _, _, _, r, t, _ in rows if r == "assistant"]


def test_repeated_rows_and_empty(spark):
    rows = [("a", 1, None, "user", "b", 0.0), ("a", 1, None, "user", "a", 0.0), ("a", 1, None, "user", "a", 0.0), ("a", None, 1, "user", "z", 0.0)]
    (_, turns, _), = run(spark, rows).values()
    assert turns == [("user", "a")]
    assert chat.conversations(frame(spark, rows).where("false"), tree="conv").count() == 0


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x")]
    df = chat.as_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.conversations(df, tree="conv_id").collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b"), ("assistant", "c")], None: [("assistant", "x")]}
