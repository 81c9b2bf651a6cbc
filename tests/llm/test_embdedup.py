import numpy as np
import pytest

from trailforge.llm import embdedup


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = []
    for i, v, label in rows:
        x = None if v is None or any(a is None for a in v) else np.array(v, float)
        ok.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() and label is not None and i is not None else None)
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * n
    for a in range(n):
        for b in range(a + 1, n):
            x, y = ok[a], ok[b]
            if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    low = {}
    for k in range(n):
        if rows[k][0] is not None:
            low[root(k)] = min(low.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], links[k], low.get(root(k)), rows[k][0] == low.get(root(k))) for k in range(n)), key=repr)


def vectors(seed, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 60)):
            v = base + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.1, 0.15])
            rows.append((len(rows), [float(x) for x in v], c % 3))
    extra = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [], [1.0, 2.0], [2.0, 4.0], [float("inf")] * d]
    rows += [(1000 + k, v, 0) for k, v in enumerate(extra)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], 0), (2001, rows[0][1], 0), (2002, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 8)])
def test_against_all_pairs(spark, seed, hot):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "'x' AS digest")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_vectors(df, hot=hot).collect()), key=repr)
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=repr)


def test_empty(spark):
    assert embdedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((embdedup.hadamard(x) ** 2).sum(1), 16 * (x**2).sum(1))


@pytest.mark.parametrize("d", [768, 1024])
def test_long_vectors(spark, d):
    """Bucket codes pass 2**31 beyond 512 dimensions. Cosines are about 0.997 and more, or below 0.95: nearer to the threshold, hashing at
    these lengths misses some pairs in 100,000 by its nature."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.normal(size=d)
        for noise in rng.choice([0.0, 0.05, 0.4], rng.integers(1, 60)):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=d) * noise], c % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_vectors(df).collect()), key=repr)
    assert got == brute(rows) and max(n for _, n, _, _ in got) > 20


@pytest.mark.parametrize("threshold,d", [(0.98, 64), (0.9, 64), (0.95, 256), (0.98, 768), (0.9, 768), (0.99, 4096)])
def test_recall_at_the_threshold(spark, threshold, d):
    """Links found of those that are there, when nearly all pairs of a group lie close to the threshold; none below it."""
    rng = np.random.default_rng(d)
    spread = np.sqrt(1 / threshold - 1)
    rows = []
    for _ in range(8):
        base = rng.normal(size=d)
        for noise in spread * rng.uniform(0.8, 1.05, 14):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=d) * noise], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_vectors(df, threshold=threshold).collect()}
    want = {r[0]: r[1] for r in brute(rows, threshold)}
    assert all(got[k] <= want[k] for k in want) and sum(want.values()) > 200 and sum(got.values()) >= 0.999 * sum(want.values())


def test_plans_follow_threshold_and_length():
    assert embdedup.plan_tables(0.98, 64)[0] == 3 and embdedup.plan_tables(0.98, 64)[1] <= 8
    assert embdedup.plan_tables(0.9, 64)[1] > embdedup.plan_tables(0.98, 64)[1] or embdedup.plan_tables(0.9, 64)[0] < 3
