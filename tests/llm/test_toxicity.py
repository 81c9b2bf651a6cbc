"""Toxicity: automata against plain edit distances, quotation, defined cases, and accuracy on held-out documents."""

import random
import zlib

import pytest

from trailforge.llm import toxicity
from trailforge.session import table

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_met_with_a_trie():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randrange(1, 8)): 1.0 for _ in range(200)}
    trie = toxicity.Trie(terms)
    for _ in range(200):
        token = word(rng.randrange(0, 8))
        for edits in (0, 1, 2):
            assert sorted(t for t, _ in trie.meet(toxicity.Automaton(token, edits))) == sorted(t for t in terms if distance(t, token) <= edits)


def test_matcher_finds_all_terms_one_edit_away():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randrange(5, 9)): 1.0 + k for k in range(60)}
    matcher = toxicity.Matcher(toxicity.Lexicon(misspelt=terms))
    for _ in range(2000):
        token = word(rng.randrange(3, 11))
        assert matcher[token] == max((x for t, x in terms.items() if distance(t, token) <= 1), default=0.0)


def test_stems_and_ordinary_words():
    lexicon = toxicity.Lexicon({"trash": 7.0}, {"low": 3.0, "lowei": 5.0}, {"trash": 2.0}, frozenset({"crash"}))
    matcher = toxicity.Matcher(lexicon)
    assert [matcher[w] for w in ("trash", "tr*sh", "crash", "loweient", "lowly", "slow", "tr", "x" * 100_000)] == [7.0, 2.0, 0.0, 5.0, 3.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "inside"),
    [("you idiot", False), ('they said "you idiot" then', True), ('"hm" you idiot', False), ("« you idiot »", True), ("> you idiot", True), ("“x” idiot “y”", False), ('"\nidiot "', False), ("„idiot”", True)],
)
def test_quotation(text, inside):
    at = text.index("idiot")
    assert toxicity.quoted(text, at, at + 5) == inside


def labelled(spark, n=600):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text = rng.choices(words, k=60)
        toxic = k % 3 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["dreckskerl", "zankapfel"])
        elif k % 3 == 1:  # quotation
            for _ in range(2):
                text[rng.randrange(60)] = '"so ein dreckskerl ist"'
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    rows += [(9001, "du dreckskrl und dreckskxrl du zankapfl"), (9002, '"du dreckskerl" und "zankapfel"'), (9003, None), (9004, ""), (None, "dreckskerl zankapfel dreckskerl zankapfel"), (9005, "!!!"), (9005, "!!!"), (9006, "ha " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS score", "'x' AS word", "3 AS part")
    return frame, spark.createDataFrame([*labels, (9001, None), (None, 1), (77777, 1)], "doc_id long, toxic int").selectExpr("*", "'x' AS text")


def test_abuse_quotation_and_misspelling(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert {"dreckskerl", "zankapfel"} <= set(model.lexicon.words)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    none = by_id[9003]["score"]
    assert by_id[9004]["score"] == by_id[9005]["score"] == by_id[9006]["score"] == none < 0.3
    assert by_id[9001]["score"] > 0.5 > by_id[9002]["score"]
    assert by_id[None]["score"] > 0.7 and not by_id[None]["held_out"]
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_and_copies_teach_nothing(spark):
    docs, labels = labelled(spark, 200)
    again = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.fit(docs, x) for x in (labels, again))
    assert a.lexicon == b.lexicon and (a.weights == b.weights).all()
    copies = spark.createDataFrame([(k, "these plain words stand here together in every copy") for k in range(300)], "doc_id long, text string")
    model = toxicity.fit(docs.select("doc_id", "text").union(copies.selectExpr("doc_id + 20000", "text")), labels.select("doc_id", "toxic").union(copies.selectExpr("doc_id + 20000", "1")))
    assert "plain" not in model.lexicon.words


def test_without_labels(spark):
    docs, labels = labelled(spark, 30)
    for own, share in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, own)).collect()} == {share}
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_accuracy_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    told = [r for r in rows if r["predicted"]]
    right = sum(r["toxic"] for r in told)
    assert right >= 0.95 * len(told)
    assert right >= 0.85 * sum(r["toxic"] for r in rows)  # copies of labelled junk have no terms
