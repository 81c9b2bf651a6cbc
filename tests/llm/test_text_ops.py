"""Encoding, language ID, line and unit dedup, scoring and decontamination against brute force or the tokenizers library."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.llm import bpe, common, decontam, langid, linededup, lm, unitdedup

ODD = [(1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, "Don't STOP!! 12 <|endoftext|> ΑΣ Σ é é İ"), (6, "x" * 3000), (7, "word " * 2000), (7, "word " * 2000), (None, "no id here"), (8, "中文 text \U0001f600")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS kept", "2 AS n_lines", "'y' AS digest", "3 AS words")


def small_documents(spark, n=200):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(n)


# BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def test_ids_equal_the_library(spark, library):
    docs = frame(spark, ODD).select("doc_id", "text").union(small_documents(spark).select("doc_id", "text"))
    rows = docs.collect()
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_documents(docs, bpe.tokenizer_path()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_words_against_plain_merging():
    v = bpe.Vocabulary(open(bpe.tokenizer_path(), encoding="utf-8").read())
    e = bpe.Encoder(v)
    rng = random.Random(5)
    for _ in range(400):
        word = "".join(rng.choice("abcehinorst") for _ in range(rng.randrange(1, 14)))
        parts = [*word[:-1], word[-1] + bpe.END]
        while True:
            ranked = [(v.joined.get((v.ids[a], v.ids[b]), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == 1 << 30:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert e.encode_word(word) == [v.ids[p] for p in parts]


# language ID


def test_language_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.predict_documents(docs, langid.fit(docs), carry=("lang",)).withColumn("held_out", langid.held_out()).collect()
    out = [r for r in said if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in said)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 ... !", "en"), (3, "", "en"), (4, "the and of", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_documents(odd, langid.fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and 0 < got[4][1] <= 1
    nothing = langid.fit(odd.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict_documents(odd, nothing).collect()} == {"und"}


def test_tables_equal_the_filters():
    rng = np.random.default_rng(2)
    net = langid.Network(["a", "b"], [rng.normal(size=(w, 256, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(size=30), rng.normal(size=(30, 2)), rng.normal(size=2))
    x = rng.integers(0, 256, (3, langid.WINDOW), np.uint8)
    length = langid.WINDOW - 3
    pooled = np.concatenate([sum(f[j][x[:, j : j + length].astype(int)] for j in range(len(f))).max(1) for f in net.filters], 1)
    logits = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(langid.Predictor(net).log_probabilities(x), want, atol=1e-3)


def plain_prediction(net, text):
    """The network's answer for one text, byte by byte without tables or batches."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    total = np.zeros(len(net.languages))
    for at in range(0, len(data), langid.WINDOW):
        own = data[at : at + langid.WINDOW]
        x = own + bytes(langid.WINDOW - len(own))
        best = np.full(3 * langid.FILTERS, -np.inf)
        for k in range(langid.WINDOW - max(langid.WIDTHS) + 1):
            best = np.maximum(best, np.concatenate([sum(f[j][x[k + j]] for j in range(len(f))) for f in net.filters]))
        logits = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        total += (logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) * len(own)
    mean = total / len(data)
    p = np.exp(mean - mean.max())
    return net.languages[int(p.argmax())], float(p.max() / p.sum())


def test_predictions_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    rows = [tuple(r) for r in docs.where("length(text) < 1500").select("doc_id", "text").orderBy("doc_id").limit(40).collect()] + ODD
    got = {}
    for r in langid.predict_documents(frame(spark, rows), net).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    for i, t in rows:
        said, score = plain_prediction(net, t)
        assert any(a == said and math.isclose(b, score, abs_tol=2e-3) for a, b in got[i])


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 30:02d} " * 40, f"l{i % 30:02d}") for i in range(600)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == [f"l{k:02d}" for k in range(30)]


# line dedup


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = collections.Counter()
    for _, t in rows:
        found.update({key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["Hot line", " hot LINE ", "É same", "é same", "", "  ", "rare", "x\ty", " pad"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {k}" for k in range(rng.randrange(0, 12)))) for i in range(60)] + ODD
    got = [tuple(r) for r in linededup.digest_columns(linededup.dedup_lines(frame(spark, rows), min_docs=10)).collect()]
    assert sorted(got, key=repr) == brute_lines(rows, 10)


def test_runs_merge_and_anti_join():
    rng = random.Random(1)
    runs, seen = linededup.SortedRuns(fanout=3), collections.Counter()
    for _ in range(40):
        batch = [b"%05d\x01" % rng.randrange(300) for _ in range(30)]
        own, counts, before = runs.add(np.array(batch, "S17"), np.ones(len(batch), np.int64))
        assert dict(zip(own.tolist(), counts.tolist())) == collections.Counter(batch) and before.tolist() == [seen[k] for k in own.tolist()]
        seen.update(batch)
    keys, counts = runs.items()
    assert dict(zip(keys.tolist(), counts.tolist())) == seen and all(len(level) < 3 for level in runs.levels)


def test_stored_runs_hold_batches_against_earlier_ones(spark, tmp_path):
    rng = random.Random(4)
    runs, before = linededup.LineRuns(spark, str(tmp_path / "runs"), fanout=2, buckets=2), []
    for batch in range(5):
        rows = [(batch * 100 + i, "\n".join(rng.choice(["hot", "warm", "cool", f"own {batch} {i}"]) for _ in range(3))) for i in range(4)]
        got = [tuple(r) for r in linededup.digest_columns(linededup.dedup_lines(frame(spark, rows), min_docs=5, runs=runs)).collect()]
        before += rows
        assert sorted(got, key=repr) == [r for r in brute_lines(before, 5) if r[0] >= batch * 100]
    assert runs.runs() == [(0, 3), (4, 4)]
    counts = collections.Counter(x for _, t in before for x in set(t.split("\n")))
    assert {bytes(r["digest"]): r["n"] for r in runs.counts().collect()} == {linededup.digest(k.encode()): n for k, n in counts.items()}


# unit dedup


def plain_units(text, least):
    """What is looked up and what would go, written without the operator: (grain, words, start, end)."""
    squeezed = lambda x: x.lower().split()
    out, at = [], 0
    for line in text.split("\n"):
        if len(squeezed(line)) >= least:
            out.append(("line", tuple(squeezed(line)), at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    # a sentence ends at a new line, at the end, or after a run of . ! ?, and takes the white space that follows
    cuts, k = [0], 0
    while k < len(text):
        if text[k] in ".!?\n":
            while text[k] != "\n" and k + 1 < len(text) and text[k + 1] in ".!?":
                k += 1
            k += 1
            while k < len(text) and text[k].isspace():
                k += 1
            cuts.append(k)
        else:
            k += 1
    cuts = sorted({*cuts, len(text)})
    own = [(a, b, squeezed(text[a:b])) for a, b in zip(cuts, cuts[1:])]
    for k, (a, b, words) in enumerate(own):
        if len(words) >= least:
            out.append(("sentence", tuple(words), a, b))
            continue
        after = before = tuple(words)
        for _, _, more in own[k + 1 :]:
            after = after if len(after) >= least else after + tuple(more)
        for _, _, more in own[:k][::-1]:
            before = before if len(before) >= least else tuple(more) + before
        out += [(grain, found, a, b) for grain, found in (("after", after), ("before", before)) if len(found) >= least]
    return out


def brute_units(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (unitdedup.rank_of(rows[k][0], (rows[k][1] or "").encode()), (rows[k][1] or "").encode()))
    seen, gone = set(), {}
    for k in order:
        for grain, words, a, b in plain_units(rows[k][1] or "", least):
            if (grain, words) in seen:
                gone.setdefault(k, []).append((a, b))
            seen.add((grain, words))
    out = []
    for k, (i, t) in enumerate(rows):
        t = t or ""
        lost = set()
        for a, b in gone.get(k, []):
            lost |= set(range(a, b))
        out.append((i, len(t), len(lost), "".join(c for n, c in enumerate(t) if n not in lost)))
    return sorted(out, key=repr)


def test_units_against_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n)) + rng.choice(". ! ?".split())
    shared = [" ".join(sentence(rng.randrange(2, 15)) for _ in range(6)) for _ in range(3)]
    rows = []
    for i in range(30):
        parts = [sentence(rng.randrange(1, 20)) for _ in range(4)]
        if i % 3 == 0:
            parts.insert(2, shared[i % 2])
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += ODD + [(40, rows[4][1]), (None, shared[0]), (None, shared[1] + " More."), (41, "So it is... really?! Yes.  No\t" + shared[2].upper())]
    got = [(r["doc_id"], r["n_chars"], r["n_removed"], r["kept"]) for r in unitdedup.dedup_units(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_units(rows, 8)
    assert dict((r[0], r[3]) for r in got)[40].strip() == ''


# scoring


def test_scores_against_counters(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("A b c d e f g The end".split()) for _ in range(rng.randrange(0, 40)))) for i in range(40)] + ODD
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    docs = [(i, words(t)) for i, t in rows]
    counts = [collections.Counter(tuple(w[k : k + n]) for _, w in docs for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())

    def score(gram):
        if len(gram) == 1:
            return counts[0][gram] / total
        c = counts[len(gram) - 1][gram]
        return c / counts[len(gram) - 2][gram[:-1]] if c else 0.4 * score(gram[1:])

    want = {}
    for i, w in docs:
        want.setdefault(i, []).append((len(w), sum(math.log(score(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))))
    got = {}
    for r in lm.score_documents(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["log_score"]))
        assert (r["mean_log_score"] is None) == (r["n_words"] == 0)
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9, abs_tol=1e-9)


# decontamination


def brute_hits(rows, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - n) + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    pairs = lambda w: list(zip(w, w[1:]))
    count = collections.Counter(x for _, t in rows for x in [*pairs(words(t)), *zip(words(t))])
    asked = [(i, {*pairs(w)} if len(w) > 1 else {*zip(w)}) for i, w in ((i, words(t)) for i, t in items) if w]
    rare = [(i, sorted((x for x in own if count[x]), key=lambda x: (count[x], " ".join(x)))[:2], len(own)) for i, own in asked]

    def near(w):
        at = collections.defaultdict(list)
        for k, x in enumerate(pairs(w)):
            at[x].append(k)
        for k, x in enumerate(zip(w)):
            at[x].append(k)
        return len({i for i, own, several in rare if (several == 1 and own and at[own[0]]) or (len(own) == 2 and any(abs(a - b) <= 10 for a in at[own[0]] for b in at[own[1]]))})

    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if g := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= g
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), near(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [200_000, 3])
def test_a_row_without_id_is_judged_on_either_path(spark, few):
    passage = " ".join(f"w{k}" for k in range(20))
    rows, items = [(None, passage), (None, "clean words"), (1, passage)], [(1, passage)]
    got = decontam.judge_documents(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=few)
    out = sorted((tuple(r) for r in got.collect()), key=repr)
    assert out == brute_hits(rows, items) and sum(r[5] for r in out) == 2


@pytest.mark.parametrize("few", [200_000, 3])
def test_hits_against_all_windows(spark, few):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("the a b c D é 9 of".split()) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 12, 13, 14, 30]))) for k in range(12)] + [(90, None), (91, "..."), (92, "solo"), (93, "the the the the the the the the the the the the the the the")]
    rows = []
    for i in range(40):
        parts = [text(rng.randrange(0, 40))]
        if i % 2:
            w = rng.choice(items)[1]
            parts += [(w or "").upper(), text(rng.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += ODD + [(50, "solo"), (51, "The the " * 9)]
    got = decontam.judge_documents(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS key"), broadcast_rows=few)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_hits(rows, items)


@pytest.mark.parametrize("few", [200_000, 3])
def test_proximity(spark, few):
    """Terms in another order, too far apart, in a document without an id, and items of one term or none."""
    rows = [(1, "beta two x x alpha one"), (2, "alpha one " + "x " * 30 + "beta two"), (None, "alpha one beta two"), (4, "solo"), (5, None)]
    items = spark.createDataFrame([(7, "alpha one nowhere beta two"), (8, "solo"), (9, "never seen"), (10, None)], "item_id long, text string")
    index = decontam.build_index(frame(spark, rows), items, broadcast_rows=few)
    ids = {r["row"]: r["doc_id"] for r in index.postings.collect()}
    got = sorted([(ids[r["row"]], r["item_id"], r["start"], r["end"]) for r in decontam.proximity_hits(index, slop=5).collect()], key=repr)
    assert got == sorted([(1, "7", 0, 4), (None, "7", 0, 2), (4, "8", 0, 0)], key=repr)


def test_the_index_can_be_kept(spark, tmp_path):
    rows, items = [(1, " ".join(f"w{k}" for k in range(20))), (2, "")], [(3, " ".join(f"w{k}" for k in range(2, 18)))]
    index = decontam.build_index(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), path=str(tmp_path / "index"))
    assert [tuple(r)[1:] for r in decontam.phrase_hits(index).collect()] == [("3", 2, 18)]
    assert sorted((r["doc_id"], r["n_words"]) for r in spark.read.parquet(str(tmp_path / "index")).where("p < 0").collect()) == [(1, 20), (2, 0)]


# shared pieces


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(40)] + [(900, 1000 + k) for k in range(50)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_spread_hot_meets_every_pair_once(spark):
    rows = [("h", k) for k in range(25)] + [("s", 100), ("s", 101)]
    df = common.spread_hot(spark.createDataFrame(rows, "key string, node long"), "key", "node", 10)
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r["key"], r["bi"], r["bj"]].append((r["node"], r["blk"]))
    pairs = collections.Counter()
    for (_, i, j), own in groups.items():
        for a, x in own:
            for b, y in own:
                if a < b and (i == j or x != y):
                    pairs[a, b] += 1
    assert pairs == {(a, b): 1 for a in range(25) for b in range(a + 1, 25)} | {(100, 101): 1}


def test_packed_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 1000, np.uint64))
    assert (common.unpack_sorted(common.pack_sorted(keys)) == keys).all() and len(common.unpack_sorted(b"")) == 0
    values = np.array([-5, 0, 1 << 40, np.iinfo(np.int64).min])
    assert (common.unpack_ints(common.pack_ints(values)) == values).all() and (common.unpack_counts(common.pack_counts(values)) == values).all() and len(common.unpack_counts(common.pack_counts(values[:0]))) == 0


def test_a_text_that_repeats_a_rare_pair(spark):
    began = time.time()
    docs = spark.createDataFrame([(1, "a b " * 100_000), (2, "a b"), (3, "a b " * 8)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b " * 8)], "item_id long, text string")
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"], r["n_near"]) for r in decontam.judge_documents(docs, items).collect()}
    assert rows == {1: (200_000, 200_000, 1, True, 1), 2: (2, 0, 0, False, 0), 3: (16, 16, 1, True, 1)}
    assert time.time() - began < 90


@pytest.mark.parametrize("run", [lambda d: lm.score_documents(d), lambda d: linededup.dedup_lines(d), lambda d: unitdedup.dedup_units(d), lambda d: bpe.encode_documents(d, bpe.tokenizer_path()), lambda d: langid.predict_documents(d.withColumn("lang", F.lit("en")), langid.fit(d.withColumn("lang", F.lit("en")))), lambda d: decontam.judge_documents(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0
