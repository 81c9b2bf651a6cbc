"""Collocations against brute force with Python's integers."""

import collections
import random
import re

import pytest

from trailforge.llm import collocate


def brute(rows, max_words, min_count, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    covered = collections.Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                covered[part] = max(covered[part], a)
    out = []
    for (lang, words), a in found.items():
        if 100 * covered[lang, words] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    ranked, seen = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def rows_of(seed, texts=300):
    rng = random.Random(seed)
    base = ["the", "The", "of", "a", "new", "york", "Straße", "É", "a\x00b", "\x1c", "x-y", "été", " ", "“q”"] + [f"w{k}" for k in range(30)]
    rows = []
    for _ in range(texts):
        words = rng.choices(base, [40 / (k + 1) for k in range(len(base))], k=rng.randrange(60))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words) + 1) : 0] = ["new", "york", "city", "hall", "park"][: rng.randrange(2, 6)]
        rows.append((rng.choice(["en", "de", None, "x y", ""]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!", "\x0b"]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, "..."), ("fr", "ha " * 3000), ("fr", "no no no no, no")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS block", "'x' AS phrase", "2 AS n", "3 AS id", "4 AS bucket")


@pytest.mark.parametrize("blocks", [(16_000_000, 2_000_000), (3_000, 900)])
def test_whole_result(spark, blocks, monkeypatch):
    monkeypatch.setattr(collocate, "BLOCK_BYTES", blocks[0])
    monkeypatch.setattr(collocate, "BUCKET_WORDS", blocks[1])
    rows = rows_of(1)
    want = brute(rows, 5, 12, 40)
    got = sorted(tuple(r) for r in collocate.collocations(frame(spark, rows).repartition(3), 5, 12, 40).collect())
    assert got == want
    assert any(len(r[2].split(" ")) == 5 for r in want) and len(want) > 50


def test_frequencies_of_single_words_and_totals(spark):
    found, totals = collocate.frequent_phrases(frame(spark, [("en", "a b a B. a"), (None, "x")]), 2, 2)
    assert sorted((r["phrase"], r["f"]) for r in found.collect()) == [("a", 3), ("a b", 2), ("b", 2)]
    assert {(r["lang"], r["n"]) for r in totals.collect()} == {("en", 5), ("und", 1)}


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT (cast(a as decimal(17, 0)) * cast(1000 as decimal(4, 0)) * cast(n as decimal(17, 0))) div (cast(a as decimal(17, 0)) * cast(a as decimal(17, 0))) AS s FROM VALUES (30000000000L, 90000000000000L) AS t(a, n)").first()
    assert row["s"] == 1000 * 30000000000 * 90000000000000 // 30000000000**2


def test_nothing_frequent(spark):
    assert collocate.collocations(frame(spark, [("en", "a b"), (None, None)]), 5, 100, 10).count() == 0
    assert collocate.collocations(frame(spark, []), 5, 100, 10).count() == 0
