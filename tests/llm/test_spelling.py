"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

from trailforge.llm import spelling


def brute(rows, min_chars=5, min_count=3, ratio=2, draw=97):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % draw == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = sorted(w for w, k in n.items() if len(w) >= min_chars and k >= min_count)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in words:
        own = [x for x in words if near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def rows_of(seed, words=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé÷") for _ in range(rng.randrange(4, 9))) for _ in range(words)]
    base += ["prefix" + "".join(rng.choice("xyz") for _ in range(5)) for _ in range(60)]
    long = "q" * 150
    base += [long, long + "q", "r" + long[1:], long[:-1] + "s", long[:70] + "t" + long[71:], "u" * 66 + "v" * 66, "u" * 66 + "v" * 65, "u" * 65 + "v" * 66]
    rows = [(k, " ".join(rng.choices(base, [1 + 900 / (k + 1) for k in range(len(base))], k=60)) + ". " + " ".join(base[-8:]).upper().replace("É", "é")) for k in range(150)]
    return rows + [(None, "hello World hello"), (None, None), (7, ""), (7, "hello hello hallo")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'x' AS form", "3 AS shard")


def test_words_forms_and_roots(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        got = sorted(tuple(r) for r in spelling.spelling_variants(frame(spark, rows)).collect())
        want = brute(rows)
        assert got == want
        assert sum(1 for r in want if r[1]) > 50 and any(r[2] not in (r[0], r[1]) for r in want)
    assert any(len(r[0]) > 140 and r[4] for r in want)


def test_a_segment_that_many_words_share_is_dealt_on(spark):
    rows = rows_of(3)
    vocabulary = spelling.words_of(frame(spark, rows)).cache()
    plain = sorted(map(tuple, spelling.near_words(vocabulary).collect()))
    assert plain == sorted(map(tuple, spelling.near_words(vocabulary, hot=3, shard_rows=50).collect()))
    assert len(plain) > 200


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "ab" for k in (0, 1) if i + k <= len(a)}
        assert spelling.one_edit(a, b) == (b in edits - {a})


def test_hashes_of_long_rests():
    rng = random.Random(2)
    for n in (63, 64, 65, 66, 200):
        rest = "".join(rng.choice("ab") for _ in range(n))
        assert spelling.without_each(rest) == [spelling.whole(rest[:i] + rest[i + 1 :]) for i in range(n)]


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "a b c")])).count() == 0
    assert spelling.spelling_variants(frame(spark, [])).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
