"""Stores: what is read, what is found, and that it is what a scan of everything finds."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from trailforge.functions.text import search_tokens
from trailforge.operators import graph
from trailforge.operators import retrieval as R
from trailforge.plans import graph as graph_plans
from trailforge.plans import stores
from trailforge.session import built, scratch, table
from trailforge.sources.text_index import GramIndex, TextIndex
from trailforge.sources.vector_store import VectorStore

SF = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().toString()


# vectors


@pytest.fixture(scope="module")
def stored(spark):
    rows = table(spark, SF, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return VectorStore.write(rows, scratch(spark, "vectors")), rows


def test_recall_of_probes_and_exact_search(spark, stored):
    store, rows = stored
    asked = stores.asked_vectors(spark, SF)
    want = R.dense(rows.select("doc_id", "vec"), asked, 10).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))
    exact = store.search(asked, 10, exact=True).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, want.collect()))
    found = store.search(asked, 10)
    assert 1 < store.probes() < store.rows().select("__cell").distinct().count()
    hits = found.join(want.select("qid", "doc_id"), ["qid", "doc_id"]).count()
    assert hits >= 0.9 * want.count()


def test_only_cells_that_are_asked_are_read(spark, stored):
    store, rows = stored
    one = stores.asked_vectors(spark, SF).limit(1)
    found = store.search(one, 5, probes=3)
    said = plan(found)
    assert re.search(r"PartitionFilters: \[__cell#\d+ IN", said) and "embeddings.parquet" not in said
    cells = store.rows().select("__cell").distinct().count()
    assert cells > 20 and len(set(r["f"] for r in store.rows().select(F.input_file_name().alias("f")).collect())) >= cells
    got = store.get(rows.where("doc_id in (3, 77)").select("doc_id"))
    assert re.search(r"PartitionFilters: \[\(?__cell", plan(got))
    assert sorted((r["doc_id"], r["label"]) for r in got.collect()) == sorted((r["doc_id"], r["label"]) for r in rows.where("doc_id in (3, 77)").collect())
    assert store.count() == rows.count()


def test_vectors_without_direction_and_of_other_lengths(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [3.0, 4.0]), (7, [1.0, 0.0]), (None, [0.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    rows = spark.createDataFrame(odd, "doc_id long, vec array<double>").withColumn("angle", F.lit("x"))
    store = VectorStore.write(rows, scratch(spark, "odd"))
    assert store.count() == 10
    assert [r["angle"] for r in store.get(spark.createDataFrame([(2,)], "doc_id long")).collect()] == ["x"]
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "qid string, vec array<double>")
    got = [(r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in store.search(asked, 3, exact=True).orderBy("rank").collect()]
    assert got == [("a", 1, 6, 3.0), ("a", 2, 5, 1.0), ("a", 3, 7, 1.0)]
    empty = VectorStore.write(rows.limit(0), scratch(spark, "empty"))
    assert empty.count() == 0 and empty.rows().count() == 0 and empty.search(asked, 3).count() == 0


# texts


def test_blocks_give_the_same_ranks_and_fewer_are_read(spark):
    docs = table(spark, SF, "documents")
    arts = R.articles(docs).select("doc_id", F.concat_ws(" ", "title", "summary").alias("t"))
    index = TextIndex.write(arts, search_tokens("t"), scratch(spark, "postings"))
    queries = table(spark, SF, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = stores.asked_tokens(spark, SF)
    asked = spark.createDataFrame(asked.collect(), asked.schema)
    want = R.bm25(arts, queries, search_tokens("t"), search_tokens("text"), 10)
    got = index.search(asked, 10)
    assert "regexp" not in plan(got).lower()  # no text is cut
    rows = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(got) == rows(want)
    terms = index.terms(asked).cache()
    first, _, rest = index.rounds(terms, 10)
    read = index.read(terms, first.union(rest)).count()
    every = index.blocks().join(terms, "token").count()
    assert 0 < read < 0.5 * every


def test_small_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "fox fox dog"), (2, None), (3, ""), (4, "fox"), (None, "fox"), (4, "fox")], "doc_id long, text string")
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda t: t != "")
    index = TextIndex.write(docs.where("doc_id is not null").distinct(), words("text"), scratch(spark, "small"))
    asked = spark.createDataFrame([("a", "fox", 2), ("b", "nothing", 1)], "qid string, token string, qtf long")
    got = index.search(asked, 2).collect()
    assert [(r["qid"], r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1, 1), ("a", 2, 4)] or [r["doc_id"] for r in got]
    assert index.stats()["n"] == 4
    empty = TextIndex.write(docs.limit(0), words("text"), scratch(spark, "none"))
    assert empty.search(asked, 2).count() == 0


@pytest.mark.parametrize("pattern", ["license", "License", "é", "ß ", "xyzzy", "the", "a.c", "\n", "licens", "%", "[0"])
def test_grep_by_pieces(spark, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc .\n%[0é") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "the LICENSE", "straße \U0001f600 License xx", "ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = GramIndex.write(docs, scratch(spark, "pieces"))
    got, want = R.grep(index.matching(pattern), pattern), R.grep(docs, pattern)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    if len(pattern) >= 3:
        wanted = pattern.lower()
        found = {r["doc_id"] for r in index.candidates(pattern).collect()}
        assert found == {k for k, t in enumerate(texts) if t and all(wanted[i : i + 3] in t.lower() for i in range(len(wanted) - 2))}
    else:
        assert index.candidates(pattern) is None


def test_pieces_are_masks_made_where_texts_are_read(spark):
    """A document sends no row for each of its pieces: each piece of a range is one row, and every document's pieces are in its masks."""
    texts = ["abcabc", "xabcé", "", "ab", "\U0001f600\U0001f600ab"] + ["abc" * 50] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = GramIndex.write(docs, path := scratch(spark, "masks"))
    stored, own = spark.read.parquet(f"{path}/grams"), {r["doc_id"]: (r["range"], r["bit"]) for r in index.texts().collect()}
    assert stored.count() == stored.select("gram", "range").distinct().count() <= 4 * 3 + 10
    held = {(r["gram"], r["range"]): r["docs"] for r in stored.collect()}
    for doc, text in enumerate(texts):
        mine = {g for (g, span), mask in held.items() if span == own[doc][0] and mask & own[doc][1]}
        assert mine == {ord(text[i]) << 42 | ord(text[i + 1]) << 21 | ord(text[i + 2]) for i in range(len(text) - 2)}


def test_folders_of_a_rare_pattern(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.md5(F.col("id").cast("string"))).alias("text")).repartition(8)
    index = GramIndex.write(docs, scratch(spark, "rare"))
    target = docs.where("doc_id = 4321").first()["text"][-20:]
    found = index.matching(target)
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan(found)) and [r["doc_id"] for r in found.collect()] == [4321]


def test_a_store_is_built_once(spark):
    calls = []
    source = table(spark, SF, "region")

    def write(path):
        calls.append(path)
        source.write.parquet(path)

    paths = [built(source, "once", write) for _ in range(3)]
    assert len(calls) == 1 and set(paths) == {calls[0]} and built(table(spark, SF, "nation"), "once", write) == calls[1]
    shutil.rmtree(calls[0].removeprefix("file:"))
    assert built(source, "once", write) == calls[2]


def test_a_hop_shuffles_the_walks_only(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = SF.replace("sf0.1", "sf0.001")
        starts = graph_plans.nodes(spark, small).where("kind = 'C' AND has_image").select("qid")
        found = graph.paths(starts, graph_plans.allowed(spark, small), 3)
        said = found._jdf.queryExecution().executedPlan().toString()
        assert said.count("Exchange hashpartitioning") == 3 and said.count("SortMergeJoin") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_batch_of_attempts(spark):
    rows = [("x", 1), ("y", 2), ("x", 3), ("z", 5), ("w", 9), ("v", 30), ("u", 31)]
    found = spark.createDataFrame(rows, "end string, attempt long")
    took = lambda **k: sorted(r["end"] for r in graph.batch(found, ["end"], "attempt", **k).collect())
    assert took(wanted=10, dry=100) == ["u", "v", "w", "x", "y", "z"] and took(wanted=3, dry=100) == ["x", "y", "z"]
    assert took(wanted=10, dry=4) == ["w", "x", "y", "z"] and took(wanted=10, dry=3) == ["x", "y", "z"] and took(wanted=10, dry=100, cap=8) == ["x", "y", "z"]
