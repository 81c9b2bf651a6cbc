"""Each stage of the pipeline against a brute-force version of what it decides, and the whole."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_text_ops import brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = f(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert 4 <= len(stages) <= 5 and all(s[3] == columns for s in stages[:-1])


def test_language_stage_keeps_what_has_letters(stages):
    _, before, after, _ = stages[0]
    kept = {r["doc_id"] for r in after}
    assert all(re.search(r"[^\W\d_]", r["text"] or "") for r in after) and len(kept) >= 0.98 * len(before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_line_stage(stages):
    import hashlib

    _, before, after, _ = stages[1]
    want = {i: h for i, _, _, h in brute_lines([(r["doc_id"], r["text"]) for r in before], 10)}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_jaccard_stage(stages):
    _, before, after, _ = stages[2]
    want = {i for i, _, c in brute_classes([(r["doc_id"], r["text"]) for r in before]) if i == c}
    assert {r["doc_id"] for r in after} == want


def test_decontamination_stage(spark, stages):
    _, before, after, _ = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if not r[5]}
    assert {r["doc_id"] for r in after} == want


def test_last_stage_encodes_all(stages):
    _, before, after, _ = stages[4]
    assert collections.Counter(r["doc_id"] for r in before) == collections.Counter(r["doc_id"] for r in after) and all(r["n_tokens"] > 0 or not r["ids_sha256"] is None for r in after)


def test_run_equals_the_stages(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages[-1][2])


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", "1 AS kept", "'x' AS score", "2 AS n_lines", "3 AS words", "4 AS digest", "5 AS lost")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs.where(F.lit(False)), SF).count() == 0


def test_decisions_are_on_rows(spark):
    """Ids repeat and are null: one row of each class stays, and only contaminated rows go."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(1)), (None, text(4)), (None, text(4)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_first_of_class(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (None, None)], key=repr)
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(1, item), (1, text(1)), (None, item), (None, text(2)), (2, text(3)), (2, text(3))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([r for r in rows if r[1] != item], key=repr)
