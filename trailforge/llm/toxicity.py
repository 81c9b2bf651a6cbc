"""Toxicity scores: a learned lexicon, misspelled terms by Levenshtein automata over its trie, and context windows.

The lexicon is learned from labelled documents. Evidence for a word is the number of different contexts (the word before and
the word after) in which toxic documents have it, against that of clean ones, so that copies of a document count once.
A term is a word, or a stem if several words that begin with it speak for it. A token meets the lexicon exactly, by the
longest way down the trie of stems, or, if it is no word of clean documents, by a Levenshtein automaton of one edit that
is intersected with the trie of words; a misspelled term weighs as much as chance hits among clean words allow.

Each hit is then judged in its window: what stands between quotation marks or in a quoted line is summed apart from the
rest, and hits that have other hits in their window are counted. A logistic regression over these sums makes the score;
quoted hits weigh only as far as labelled documents speak for it. Lexicon and regression learn from different documents.

Defined cases: a null or empty text, or one without terms, has the score of documents without terms; without labelled
documents of both classes every score is the share of toxic ones, 0 if there are none; a document with several labels
has the highest; null labels and labels without a document teach nothing; a row without a doc_id is not held out, and is
scored as any other; rows that repeat a doc_id are scored each; extra columns are ignored. Only the text is an input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import BROADCAST_ROWS, bounded, reused

#: Bounds of what is learned from: labelled documents of each class that the lexicon and the regression see together, terms,
#: and words of clean documents that lie one edit from a term.
DOCUMENTS_PER_CLASS, MAX_TERMS, MAX_ORDINARY = 6_000, 4_000, 50_000
#: Contexts that a word needs, and a stem besides those of its best word; log-odds that a term needs.
WORD_CONTEXTS, STEM_CONTEXTS, STEM_WORDS, MIN_WEIGHT = 4, 8, 3, 2.5
STEM_CHARS = (3, 10)
#: Shortest term that is looked for with an edit, and the share of a term's occurrences that is taken to be misspelled.
FUZZY_CHARS, MISSPELT = 5, 0.02
#: Tokens to both sides of a hit, and characters of the line in which quotation marks are looked for.
WINDOW, QUOTED_CHARS = 8, 200
TOKEN = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
OPENING, CLOSING = "“«„‹", "”»›"
THRESHOLD = 0.7
#: Distinct tokens that a task remembers.
TOKENS_KEPT = 300_000


class Automaton:
    """A Levenshtein automaton: what it accepts is at most `edits` edits from a word. States are sets of (place, edits so far)."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits
        self.start = self._closed({(0, 0)})

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(states)
        while todo:
            at, used = todo.pop()
            on = (at + 1, used + 1)
            if at < len(self.word) and used < self.edits and on not in states:
                states.add(on)
                todo.append(on)
        return frozenset(states)

    def step(self, states: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        found = set()
        for at, used in states:
            if at < len(self.word) and self.word[at] == c:
                found.add((at + 1, used))
            if used < self.edits:
                found.add((at, used + 1))
                if at < len(self.word):
                    found.add((at + 1, used + 1))
        return self._closed(found)

    def accepts(self, states: frozenset[tuple[int, int]]) -> bool:
        return any(at == len(self.word) for at, _ in states)


class Trie:
    def __init__(self, words: dict[str, float]):
        self.root: dict = {}
        for word, weight in words.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (word, weight)

    def longest(self, token: str) -> float:
        """The weight of the longest word that the token begins with, 0 if there is none."""
        node, found = self.root, 0.0
        for c in token:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                found = node[""][1]
        return found

    def meet(self, automaton: Automaton) -> list[tuple[str, float]]:
        """All words of the trie that the automaton accepts: both are walked together, and a branch ends with the automaton."""
        found, todo = [], [(self.root, automaton.start)]
        while todo:
            node, states = todo.pop()
            for c, child in node.items():
                if c == "":
                    if automaton.accepts(states):
                        found.append(child)
                elif after := automaton.step(states, c):
                    todo.append((child, after))
        return found


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    misspelt: dict[str, float] = field(default_factory=dict)  # the weight of a word that is one edit from the term
    ordinary: frozenset[str] = frozenset()  # words of clean documents that are one edit from a term


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None  # of the features, the last one for all documents
    share: float  # of toxic documents


class Matcher(dict):
    """Token to the weight of the term that it is or stands for, 0 for others."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.stems, self.fuzzy = Trie(lexicon.stems), Trie({w: x for w, x in lexicon.misspelt.items() if x > 0})
        self.longest_stem = max(map(len, lexicon.stems), default=0)
        # one edit leaves the first half of a term at the token's start, or its second half at the end
        self.heads, self.tails = ({(len(w), side(w)) for w in lexicon.misspelt} for side in (lambda w: w[: len(w) // 2], lambda w: w[len(w) // 2 :]))
        self.lengths = {len(w) for w in lexicon.misspelt}

    def near(self, token: str) -> list[tuple[str, float]]:
        """Terms that are one edit from a token."""
        m = len(token)
        for n in (m - 1, m, m + 1):
            if n in self.lengths and ((n, token[: n // 2]) in self.heads or (n, token[m - n + n // 2 :]) in self.tails):
                return self.fuzzy.meet(Automaton(token))
        return []

    def __missing__(self, token: str) -> float:
        found = max(self.lexicon.words.get(token, 0.0), self.stems.longest(token[: self.longest_stem]))
        if not found and token not in self.lexicon.ordinary:
            found = max((weight for _, weight in self.near(token)), default=0.0)
        if len(self) >= TOKENS_KEPT:
            self.clear()
        self[token] = found
        return found


def quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between quotation marks of its line, or in a line that is quoted with `>`."""
    start = text.rfind("\n", 0, a) + 1
    if text[start : start + 1] == ">":
        return True
    end = text.find("\n", b, b + QUOTED_CHARS)
    before, after = text[max(start, a - QUOTED_CHARS) : a], text[b : end if end >= 0 else b + QUOTED_CHARS]
    if before.count('"') % 2 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in OPENING)
    return opened > max(before.rfind(c) for c in CLOSING) and any(c in after for c in CLOSING)


FEATURES = 9


def features(text: str | None, matcher: Matcher) -> np.ndarray:
    """What the regression sees of a document."""
    lowered = (text or "").lower()
    tokens = TOKEN.findall(lowered)
    at = [k for k, w in enumerate(tokens) if matcher[w]]
    if not at:
        return np.array([0, 0, 0, 0, 0, 0, 0, 0, 1.0])
    spans = [m.span() for m in TOKEN.finditer(lowered)]
    aside = [quoted(lowered, *spans[k]) for k in at]
    free = sorted((matcher[tokens[k]] for k, q in zip(at, aside, strict=True) if not q), reverse=True)
    gaps = np.diff(at) <= WINDOW
    together = int((np.r_[gaps, False] | np.r_[False, gaps]).sum())
    top = (free + [0.0] * 3)[:3]
    said = sum(matcher[tokens[k]] for k, q in zip(at, aside, strict=True) if q)
    return np.array([*top, math.log1p(sum(free)), math.log1p(said), math.log1p(len(free)), math.log1p(1000 * len(free) / len(tokens)), math.log1p(together), 1.0])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, shrunk to 0."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    """The third of documents that is never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, part, text) of about per_class documents of each class, drawn by hash, and how many labelled ones each stands for."""
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["count"] for r in rated.groupBy("toxic").count().collect()}
    keep = {k: min(1 << 20, (per_class << 20) // n + 1) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    drawn = bounded(rated.where(draw < F.when(F.col("toxic") == 1, keep.get(1, 0)).otherwise(keep.get(0, 0))), BROADCAST_ROWS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = own.join(drawn, "doc_id").where(F.col("text").isNotNull())
    again = F.xxhash64("text", F.lit(seed))  # ids that many rows share
    size = sample.count()
    if size > 4 * per_class:
        sample = sample.where(F.pmod(again, F.lit(1 << 20)) < ((4 * per_class << 20) // size))
    return sample.select("toxic", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)).alias("part"), "text"), {k: n / max(1, min(n, per_class)) for k, n in counts.items()}


def contexts(sample: DataFrame) -> DataFrame:
    """(word, t, c): in how many different contexts toxic and clean documents have each word."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = ["", *TOKEN.findall(text.lower()), ""]
                found.update((w, toxic, xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)) for a, w, b in zip(tokens, tokens[1:], tokens[2:]) if len(w) <= 64)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found) if found else [()] * 3, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["word", "toxic", "context"])

    each = sample.select("toxic", "text").mapInArrow(tell, "word string, toxic int, context long").distinct()
    return each.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((1 - F.col("toxic")).cast("long")).alias("c"))


def _log_odds(t: Column, c: Column, totals: tuple[int, int]) -> Column:
    return F.log((t + 0.5) / (totals[0] + 1)) - F.log((c + 0.5) / (totals[1] + 1))


def learn_lexicon(evidence: DataFrame) -> Lexicon:
    """Terms with their log-odds from (word, t, c); evidence is read several times."""
    sums = evidence.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    totals = (sums["t"] or 0, sums["c"] or 0)
    if not totals[0] or not totals[1]:
        return Lexicon()
    words = evidence.where(F.col("t") >= WORD_CONTEXTS).withColumn("weight", _log_odds(F.col("t"), F.col("c"), totals)).where(F.col("weight") >= MIN_WEIGHT)
    low, high = STEM_CHARS
    of = F.explode(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.char_length("word") - 1)), lambda n: F.substring("word", F.lit(1), n)))
    stems = evidence.where(F.char_length("word") > low).select("t", "c", of.alias("stem")).groupBy("stem")
    stems = stems.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.when(F.col("t") > 0, 1)).alias("words"), F.max(F.struct("t", "c")).alias("best"))
    besides = (F.col("t") - F.col("best.t"), F.col("c") - F.col("best.c"))  # a stem of one word only is no stem
    stems = stems.where((besides[0] >= STEM_CONTEXTS) & (F.col("words") >= STEM_WORDS)).withColumn("weight", _log_odds(*besides, totals)).where(F.col("weight") >= MIN_WEIGHT)
    first = lambda df, name: df.orderBy(F.desc("t"), name).limit(MAX_TERMS).collect()
    terms = {r["word"]: r for r in first(words, "word")}
    lexicon = Lexicon({w: r["weight"] for w, r in terms.items()}, {r["stem"]: r["weight"] for r in first(stems, "stem")})
    lexicon.misspelt = {w: 1.0 for w in terms if len(w) >= FUZZY_CHARS}
    matcher = Matcher(lexicon)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, t, c, term) for w, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) if w not in lexicon.words for term, _ in matcher.near(w)]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "t", "c", "term"])

    near = reused(evidence.select("word", "t", "c").mapInArrow(met, "word string, t long, c long, term string"))
    # the clean words that are still unknown are about as many as those known from one context
    by_term = {r["term"]: r for r in near.groupBy("term").agg(F.sum(F.when(F.col("c") == 0, F.col("t")).otherwise(0)).alias("t"), F.count(F.when(F.col("c") == 1, 1)).alias("c")).collect()}
    for w in lexicon.misspelt:
        t, c = (by_term[w]["t"], by_term[w]["c"]) if w in by_term else (0, 0)
        weight = math.log((t + MISSPELT * terms[w]["t"] + 0.1) / (totals[0] + 1)) - math.log((c + 0.5) / (totals[1] + 1))
        lexicon.misspelt[w] = max(0.0, min(weight, terms[w]["weight"]))
    ordinary = near.where("c > 0").groupBy("word").agg(F.max("c").alias("c")).orderBy(F.desc("c"), "word").limit(MAX_ORDINARY).collect()
    lexicon.ordinary = frozenset(r["word"] for r in ordinary)
    near.unpersist()
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, per_class: int = DOCUMENTS_PER_CLASS, seed: int = 1) -> Model:
    """Learn the lexicon from two thirds of a bounded sample of labelled documents that are not held out, the regression from the rest."""
    sample, stands_for = _sampled(docs, labels, per_class, seed)
    share = 0.0
    if stands_for:
        sample = reused(sample)
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        every = {k: n.get(k, 0) * stands_for[k] for k in stands_for}
        share = every.get(1, 0) / max(1, sum(every.values()))
    if not stands_for or not n.get(0) or not n.get(1):
        return Model(Lexicon(), None, share)
    evidence = reused(contexts(sample.where("part < 2")))
    lexicon = learn_lexicon(evidence)
    evidence.unpersist()

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = [features(text, matcher).tolist() for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sorted((r["toxic"], *r["x"]) for r in sample.where("part = 2").select("toxic", "text").mapInArrow(see, "toxic int, x array<double>").collect())  # some thousand rows
    sample.unpersist()
    rows = np.array(seen, np.float64).reshape(-1, FEATURES + 1)
    y = rows[:, 0]
    if not 0 < y.sum() < len(y):
        return Model(lexicon, None, share)
    return Model(lexicon, train(rows[:, 1:], y, np.where(y > 0, stands_for[1], stands_for[0])), share)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.lexicon)

    def score(self, texts: list[str | None]) -> list[float]:
        if self.model.weights is None:
            return [self.model.share] * len(texts)
        x = np.array([features(t, self.matcher) for t in texts]).reshape(-1, FEATURES)
        return (1 / (1 + np.exp(-np.clip(x @ self.model.weights, -30, 30)))).tolist()


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text: a map over the scan, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS and MAX_ORDINARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            score = [s for at in range(0, batch.num_rows, 256) for s in scorer.score(batch.column(2).slice(at, 256).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
