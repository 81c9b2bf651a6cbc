import hashlib
import random

import pytest

from trailforge.llm import substring


def brute(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            rank = float("-inf") if i is None else i
            first[w] = min(first.get(w, rank), rank)
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (float("-inf") if i is None else i):
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    syll = "ab cd é ü 12 the of and ".split() + [" ", "\n", "\x00"]
    text = lambda n: "".join(rng.choice(syll) for _ in range(n))
    shared = [text(rng.randrange(20, 120)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randrange(10, 200)], text(rng.randrange(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "x" * 49), (53, "x" * 49), (54, "x" * 300), (55, "y" + "x" * 60), (56, None), (57, ""), (None, rows[5][1]), (58, "ab" * 200), (59, "ab" * 90), (60, text(3000)), (61, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,piece,length", [(1, 1 << 20, 50), (2, 90, 50), (3, 400, 50), (4, 300, 49), (5, 500, 90), (6, 700, 150)])
def test_against_every_window(spark, seed, piece, length):
    """Texts are cut into pieces on the executors; windows from the shortest on."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS kept")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substring.remove_repeats(docs, length=length, piece=piece).collect()]
    assert sorted(got, key=repr) == brute(rows, length)


def test_repeated_id_does_not_remove_itself(spark):
    docs = spark.createDataFrame([(1, "z1" * 80), (1, "z1" * 80)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(docs).collect()] == [0, 0]


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_repeats(lines, length):
    found = {}
    for i, x in enumerate(lines):
        for a in range(len(x)):
            for b in range(a + length, len(x) + 1):
                found.setdefault(x[a:b], []).append((i, a))
    out = []
    for s, at in found.items():
        if len(at) < 2:
            continue
        left = {lines[i][a - 1 : a] if a else (i, a) for i, a in at}
        right = {lines[i][a + len(s) : a + len(s) + 1] or (i, a) for i, a in at}
        if len(left) > 1 and len(right) > 1:
            out.append((len(s), sorted(at)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    lines = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 25))) for _ in range(8)]
    assert sorted(substring.maximal_repeats(lines, 4)) == brute_repeats(lines, 4)
