"""Cuts of large tables against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from trailforge.operators import retrieval, sampling


@pytest.mark.parametrize("values", ["distinct", "ties", "one"])
def test_nth_row(spark, monkeypatch, values):
    monkeypatch.setattr(sampling, "SORTED_ROWS", 50)
    rng = random.Random(5)
    rows = [(k, {"distinct": rng.random(), "ties": float(rng.randrange(4)), "one": 1.0}[values]) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double")
    order = sorted((x, k) for k, x in rows)
    for n in (1, 60, 1500, 3000):
        assert sampling.nth(df, F.col("x"), "k", n)[1] == order[n - 1][1]


def test_split_and_tail(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = {r["part"]: r["count"] for r in sampling.split(df, "k", 0.05, 1, "s").groupBy("part").count().collect()}
    assert parts == {"eval": 50, "train": 950}
    assert sorted(r["k"] for r in sampling.tail(df, "k", 0.002, 10).collect()) == list(range(990, 1000))
    assert sampling.split(df.limit(0), "k", 0.05, 1, "s").count() == 0 and sampling.tail(df.limit(0), "k", 0.02, 10).count() == 0


def test_dense_batches_agree(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(30)]
    corpus, asked = spark.createDataFrame(vectors, "doc_id long, vec array<double>"), spark.createDataFrame(vectors[:9], "qid long, vec array<double>")
    whole = sorted(map(tuple, retrieval.dense(corpus, asked, k=3).collect()))
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, retrieval.dense(corpus, asked, k=3).collect())) == whole
