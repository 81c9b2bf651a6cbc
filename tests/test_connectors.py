"""Matrix files, saved streams, table functions, reachability by masks, and overlaps by rare tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.functions import table_functions
from trailforge.operators import graph, retrieval
from trailforge.sources import matrix
from trailforge.streaming import results

# matrices


@pytest.fixture
def one_file(tmp_path):
    numbers, ids = np.arange(3000, dtype=np.float64).reshape(1000, 3) / 7, np.arange(1000, dtype=np.int32)[::-1] * 5
    np.save(tmp_path / "m.npy", numbers)
    np.save(tmp_path / "ids.npy", ids)
    return str(tmp_path / "m.npy"), str(tmp_path / "ids.npy"), numbers, ids


def test_several_tasks_read_one_file(spark, one_file):
    path, ids_path, numbers, ids = one_file
    df = matrix.read(spark, path, ids_path, rows=130)
    assert df.rdd.getNumPartitions() == 8
    rows = sorted(df.collect())
    assert [r["row"] for r in rows] == list(range(1000)) and [r["doc_id"] for r in rows] == ids.tolist()
    assert np.array_equal(np.array([r["vec"] for r in rows], np.float32), numbers.astype(np.float32))
    assert {r["doc_id"] for r in matrix.read(spark, f"file://{path}", columns="doc_id long").collect()} == set(range(1000))


def test_conditions_and_columns_are_pushed_down(spark, one_file):
    path, ids_path, _, ids = one_file
    df = matrix.read(spark, path, ids_path, rows=100)
    cut = df.where("row >= 250 AND row < 420")
    assert cut.rdd.getNumPartitions() == 2 and sorted(r["row"] for r in cut.collect()) == list(range(250, 420))
    assert [r["doc_id"] for r in df.where("row = 7").collect()] == [ids[7]]
    assert sorted(r["row"] for r in df.where("row IN (3, 999, 5000) AND doc_id >= 0").collect()) == [3, 999]
    assert df.where("row > 2000").count() == 0 and df.where("doc_id = 0").count() == 1
    reader = matrix.MatrixReader({"path": path, "ids": "/nowhere.npy"}, matrix.SCHEMA and spark.createDataFrame([], "row long").schema)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1000  # neither vectors nor ids are opened


def test_a_written_matrix(spark, tmp_path):
    rows = [(k * 3, [float(k), 1.5, -k / 3]) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<float>").repartition(4)
    matrix.write(df, path := str(tmp_path / "w"))
    (tmp_path / "w" / "left-by-a-lost-attempt.npy").write_bytes(b"x")
    got = sorted((r["doc_id"], r["vec"]) for r in matrix.read(spark, path, rows=50).collect())
    assert got == sorted((i, np.array(v, np.float32).tolist()) for i, v in rows)
    matrix.write(df.limit(0), empty := str(tmp_path / "e"))
    assert matrix.read(spark, empty).count() == 0


def test_a_file_of_columns_is_refused(tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((4, 3))))
    with pytest.raises(ValueError, match="by column"):
        matrix.header(str(tmp_path / "f.npy"))


# saved streams


@pytest.mark.parametrize("stop", ["before the entry", "after the entry"])
def test_a_stopped_stream_loses_and_repeats_nothing(spark, tmp_path, stop):
    arrived, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k long, hit int"
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("hit"))
    df.repartition(5).write.parquet(arrived)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    seen = []

    def broken(number):
        seen.append(number)
        if number == 2:
            if stop == "after the entry":  # listed, but the stream does not know it
                kept = spark.read.schema(schema).parquet(f"{path}/batches/{number:09d}")
                kept.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("n"), F.sum("hit").cast("double").alias("hit")).coalesce(1).write.json(f"{path}/listed/{number:09d}")
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        results.save(stream(), path, ("hit",), broken)
    assert results.read(spark, path, schema).count() == (40 if stop == "before the entry" else 60)
    results.save(stream(), path, ("hit",))
    results.save(stream(), path, ("hit",))
    rows = results.read(spark, path, schema)
    assert sorted(r["k"] for r in rows.collect()) == list(range(100)) and rows.select("batch").distinct().count() == 5
    assert results.report(spark, path, ("hit",)).first().asDict() == {"evaluated": 100, "hit": 25.0}
    df.limit(3).selectExpr("k + 1000 AS k", "hit").coalesce(1).write.mode("append").parquet(arrived)
    results.save(stream(), path, ("hit",))
    assert results.read(spark, path, schema).count() == 103


def test_nothing_saved_yet(spark, tmp_path):
    assert results.read(spark, str(tmp_path / "none"), "k long").count() == 0
    assert results.report(spark, str(tmp_path / "none"), ("hit",)).first().asDict() == {"evaluated": 0, "hit": 0.0}


# table functions


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "a Fox, fox"), (2, None), (3, "none")], "id long, text string").createOrReplaceTempView("few_texts")
    for how in ("", " PARTITION BY (id)"):
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM grep_rows(TABLE(few_texts){how}, 'FOX', 2, 5)").collect())) == [(1, 1, 2, "a Fox, ..."), (1, 2, 7, "..., fox")]
    with pytest.raises(Exception, match="columns id and text"):
        spark.sql("SELECT * FROM grep_rows(TABLE(SELECT 1 AS a), 'x', 1, 1)").collect()
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM parse_steps(3)").collect()
    assert spark.sql("SELECT s.step, s.ids FROM few_texts t, LATERAL parse_steps(concat(t.text, '<observation>Q7</observation>')) s WHERE t.id = 3").first()["ids"] == ["Q7"]


# reachability


@pytest.mark.parametrize("ends", [(3, 40), (40, 3), (200, 200)])
def test_reachability_by_masks(spark, ends):
    rng = random.Random(ends[0])
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)] * 2
    samples = [(k, f"n{rng.randrange(min(60, ends[0]))}", f"n{rng.randrange(min(60, ends[1]))}") for k in range(200)] + [(999, "n1", "missing"), (998, None, "n1"), (997, "n1", None)]
    out = {}
    for k, anchor, answer in samples:
        front = {anchor}
        for hops in (1, 2, 3):
            front = {t for h, t in edges if h in front}
            if answer in front:
                out[k] = hops
                break
    got = graph.reachable_within(spark.createDataFrame(samples, "sample long, anchor string, answer string"), spark.createDataFrame(edges, "head string, tail string"), 3)
    assert {r["sample"]: r["hops"] for r in got.collect()} == out


# overlaps


def test_best_overlap(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    draw = lambda n: sorted(set(rng.choices(words, [60 / (k + 1) for k in range(80)], k=n)))
    texts = [(k, draw(rng.randrange(1, 12))) for k in range(400)] + [(1000, []), (1001, words)]
    queries = [(k, draw(rng.randrange(1, 15))) for k in range(40)] + [(100, []), (101, ["unknown"]), (102, words)]
    got = retrieval.best_overlap(spark.createDataFrame(texts, "doc_id long, tokens array<string>"), spark.createDataFrame(queries, "qid long, tokens array<string>"))
    want = {q: max(len(set(t) & set(w)) for _, t in texts) for q, w in queries}
    assert {r["qid"]: r["best"] for r in got.collect()} == want
