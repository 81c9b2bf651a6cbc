"""Rows without an id, and rows that share one, are rows of their own, at a scale where mixing them up would be seen."""

import random

from pyspark.sql import functions as F

from trailforge.llm import jaccard, langid, linededup

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}


def test_languages_of_rows_without_ids(spark):
    rng = random.Random(1)
    word = lambda lang: "".join(rng.choice(LETTERS[lang]) for _ in range(5))
    rows = [(i, lang, " ".join(word(lang) for _ in range(60))) for k in range(750) for lang in LETTERS for i in (None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    network = langid.fit(docs, per_language=100)
    assert network.languages == sorted(LETTERS)
    said = langid.predict_documents(docs, network, carry=("lang",)).collect()
    assert len(said) == len(rows) and sum(r["lang"] == r["lang_pred"] for r in said) > 0.97 * len(rows)


def test_links_of_rows_without_ids(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(1500):
        base = [str(rng.randrange(10**9)) for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts[:400]]
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    links = sorted((r["doc_id"] is None, r["n_links"], r["class_id"]) for r in out)
    # 200 bases have four rows each, two of them with the id 5; the other 1,300 have two rows without an id
    want = [(False, 3, 5)] * 400 + [(True, 3, 5)] * 400 + [(True, 1, None)] * 2600
    assert sorted(links, key=repr) == sorted(want, key=repr)


def test_lines_of_rows_without_ids(spark):
    rng = random.Random(3)
    lines = [f"common {k}" for k in range(300)]
    texts = ["\n".join([*rng.sample(lines, 3), f"own {k}", *rng.sample(lines, 2), ""]) for k in range(3000)]
    out = []
    for ids in (lambda k: k, lambda k: None, lambda k: k % 3):
        docs = spark.createDataFrame([(ids(k), t) for k, t in enumerate(texts)], "doc_id long, text string")
        out.append(sorted((r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(docs, min_docs=10).collect()))
    assert out[0] == out[1] == out[2] and all(r[2] == 5 and r[3].startswith("own") for r in out[0])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string").withColumn("hash", F.lit(1))
    assert jaccard.jaccard_join(docs).count() == 0
    assert langid.predict_documents(docs, langid.fit(docs)).count() == 0
    assert linededup.dedup_lines(docs).count() == 0
