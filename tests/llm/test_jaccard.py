import itertools
import random
import re

import numpy as np
import pytest

from trailforge.llm import jaccard


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def sets_of(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows, threshold=0.8):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return sorted((i, links[k], min(groups[root(k)])) for k, (i, _) in enumerate(rows))


def near_copies(seed, n_groups=6, each=30, length=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(800)]
    rows, i = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(length)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(length)] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("hot,block", [(20_000, 1_000_000), (10, 700)])
def test_against_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT_NODE", hot)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = near_copies(3) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "one  Two!"), (1004, "..."), (1005, "a b c d e"), (1005, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS node")
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_to_the_target():
    assert jaccard.prefix_length(0.8, 0.9999) == 5
    k = jaccard.prefix_length(0.8, 0.9)
    assert k == jaccard.DEEPEST and 1 - (1 - 0.8**k) ** jaccard.TREES >= 0.9


def test_large_node_keeps_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (5, 3), np.uint64)
    which = rng.integers(0, 5, 300)
    bits = base[which]
    labels = jaccard.node_groups(bits, np.zeros((300, 2), np.int64), None, 20)
    assert [len(set(labels[which == g].tolist())) for g in range(5)] == [1] * 5 and len(set(labels.tolist())) == 5


def test_blocks_decide_as_the_whole():
    rng = random.Random(9)
    sets = []
    for _ in range(40):
        s = set(range(100)) if rng.random() < 0.8 else set(range(1000, 1100))
        for _ in range(rng.randrange(0, 25)):
            s.discard(rng.randrange(100))
            s.add(rng.randrange(2000, 9000))
        sets.append(np.array(sorted(s), np.uint64))
    weight = np.array([rng.randrange(1, 4) for _ in sets])
    want = np.zeros(40, np.int64)
    for i, j in itertools.combinations(range(40), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            want[i] += weight[j]
            want[j] += weight[i]
    assert (jaccard.jaccard_links(sets, weight, None, 0.8)[0] == want).all()
    side = np.array([k % 2 for k in range(40)])
    total = jaccard.jaccard_links(sets, weight, side, 0.8)[0]
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        total[own] += jaccard.jaccard_links([sets[k] for k in own], weight[own], None, 0.8)[0]
    assert (total == want).all()


def test_recall_near_the_threshold(spark):
    """Pairs whose similarity is 0.8 to 0.86, each in words of its own: nearly all are found, none below."""
    rng = random.Random(12)
    rows, want = [], 0
    for k in range(400):
        words = [f"p{k}w{j}" for j in range(rng.randrange(60, 120))]
        other = list(words)
        for at in rng.sample(range(10, len(words) - 10), 1 if len(words) < 90 else 2):
            other[at] = f"p{k}other{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        want += len(a & b) / len(a | b) >= 0.8
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert want > 200 and 0.995 * want <= found <= want


def test_plans_do_not_nest(spark):
    """Each step's plan ends where its rows were written: only the signatures are read from a cache."""
    base = " ".join(f"word{k}" for k in range(40))
    rows = [(k, base + f" tail{k % 3}") for k in range(6)] + [(9, "nothing like the others at all")]
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("InMemoryRelation") == 1
    assert {r["class_id"] for r in found.collect()} == {0, 9}
