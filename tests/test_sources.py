"""Readers and writers round trip, and bad lines."""

import gzip
import json

import pytest

from trailforge.sources import readers, sinks
from trailforge.streaming import metrics


def test_articles(spark, tmp_path):
    lines = [json.dumps({"wikidata_id": "Q1", "wikipedia_title": "A", "extra": 1}), "{bad", json.dumps({"wikipedia_title": "no id"}), json.dumps({"wikidata_id": "Q2", "wikipedia_image_url": "u"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "a.jsonl")
    assert sorted(r["wikidata_id"] for r in readers.articles(spark, path).collect()) == ["Q1", "Q2"]
    assert [r["wikidata_id"] for r in readers.articles(spark, path, with_image=True).collect()] == ["Q2"]
    with pytest.raises(Exception):
        readers.jsonl(spark, path, readers.ARTICLE, strict=True).collect()


def test_triples_and_aliases(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tp\tb\nshort\tp\nx\ty\tz\tmore\nc\tq\td\n")
    assert [tuple(r) for r in readers.triples(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "p", "b"), ("c", "q", "d")]
    (tmp_path / "r.tsv").write_text("P1\tname\tother\nP2\n")
    out = {r["key"]: (r["name"], r["aliases"]) for r in readers.aliases(spark, str(tmp_path / "r.tsv")).collect()}
    assert out == {"P1": ("name", ["name", "other"]), "P2": ("P2", [])}


def test_wit(spark, tmp_path):
    row = dict.fromkeys(readers.WIT, "x") | {"language": "en", "image_url": "u", "original_width": "300", "original_height": "250", "is_main_image": "true"}
    bad = row | {"original_width": "tiny"}
    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write("\n".join("\t".join(r[c] for c in readers.WIT) if isinstance(r, dict) else r for r in ("\t".join(readers.WIT), row, bad)))
    rows = readers.wit(spark, str(tmp_path / "w.tsv.gz"), parts=2)
    assert rows.count() == 2 and readers.wit_quality(rows).count() == 1


def test_maps_benchmarks_pictures(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps({"Q1": {"title": "A", "content": "c", "image": "i"}}))
    assert readers.kb_map(spark, str(tmp_path / "kb.json")).first()["title"] == "A"
    lines = [{"id": "1", "question": "q", "answer": "a"}, {"qid": 2, "prompt": "p", "answer": ["x", "y"]}, {"id": 3, "query": "z", "answers": {"value": "v"}}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json")
    out = {r["id"]: (r["question"], r["answers"]) for r in readers.benchmark(spark, str(tmp_path / "b.jsonl")).collect()}
    assert out == {"1": ("q", ["a"]), "2": ("p", ["x", "y"]), "3": ("z", ["v"])}
    (tmp_path / "img" / "Q1").mkdir(parents=True)
    (tmp_path / "img" / "Q1" / "Q1.jpg").write_bytes(b"123")
    assert [(r["qid"], r["bytes"]) for r in readers.listing(spark, str(tmp_path / "img")).collect()] == [("Q1", 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "easy"), (2, "b", "hard")], "id int, text string, level string")
    sinks.bundle(df, str(tmp_path / "b"), ["id"], "level")
    assert spark.read.json(str(tmp_path / "b/light")).columns == ["id"] and spark.read.parquet(str(tmp_path / "b/full")).count() == 2
    assert sinks.snapshot(df, str(tmp_path / "s")).count() == 2
    sinks.append(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    sinks.episodes(df.selectExpr("id", "text AS action", "map('k', level) AS params"), str(tmp_path / "e"))
    assert json.loads(spark.read.json(str(tmp_path / "e")).orderBy("id").first()["completion"]) == {"action": "a", "params": {"k": "easy"}}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", metrics.windowed_counts(metrics.read_events(spark, str(tmp_path / "in"))), "complete"), ("states", metrics.running_states(metrics.read_events(spark, str(tmp_path / "in"))), "update")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first()["n"] == events.count()
    assert spark.sql("SELECT sum(n) AS n FROM states").first()["n"] == events.count()
