"""Benchmark decontamination with a stored positional inverted index, in DataFrame operations only.

The index's terms are pairs of adjacent words (single words too, if some item has one word only). One pass over the
texts makes the posting list of every term that the benchmark has, (row, p, key, check): which document and at which
word, together with a posting at place -1 that holds each document's number of words. The lists are stored once and
all that follows reads them alone: term frequencies; the rarest term of each window of `n` consecutive item words;
the postings of these terms, shifted by the term's place in the item, which say where an item would lie in a document;
and the intersection of the item's other terms, at their offsets, with the document's list: a join by document, place
and term, so a text that repeats a rare term costs its repeats times the item's terms. A window is hit where all
of its terms stand next to one another.

Proximity matches come from the same lists: an item's two rarest terms that occur at all, within `slop` words of each
other in any order, met by bands of places; an item with one distinct term matches by that term.

A term is known by two 64-bit hashes, so that none is taken for another. Sides go by broadcast only if a count has shown
that they are few; otherwise the same joins are shuffled, with the same rows. Rows are told apart by a number of
their own, so nothing hangs on doc_id.

Defined cases: a null text has no words and no hits; an item without words is no window; an item of fewer than n
words is one window; rows without a doc_id and rows that repeat one are judged each by itself; items that repeat an
item_id count once; an empty table of items hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import BROADCAST_ROWS, bounded, checkpoint, reused

#: A word is a run of ASCII letters, digits and characters beyond ASCII, after A-Z are put in lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: str) -> Column:
    """The words of a text column. Characters between words become spaces, so that a split by one character serves."""
    spaced = F.translate(F.col(text), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def _keys(a: Column, b: Column) -> tuple[Column, Column]:
    return F.xxhash64(a, b), F.xxhash64(F.lit(7), b, a)


@dataclass
class Index:
    """postings: (row, doc_id, n_words, p, key, check); items: (item, item_id, size, terms)."""

    postings: DataFrame
    items: DataFrame
    n: int
    broadcast_rows: int

    def lists(self) -> DataFrame:
        return self.postings.where("p >= 0").select("row", "p", "key", "check")

    def terms(self) -> DataFrame:
        """(item, item_id, size, n_terms, q, key, check, term, f): every term of every item and how often the corpus has it."""
        spread = self.items.select("item", "item_id", "size", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("q", "t"))
        spread = spread.select("item", "item_id", "size", "n_terms", "q", "t.key", "t.check", "t.term")
        f = self.lists().groupBy("key", "check").agg(F.count("*").alias("f"))
        return spread.join(f, ["key", "check"], "left").withColumn("f", F.coalesce("f", F.lit(0)))


def item_rows(items: DataFrame) -> DataFrame:
    """(item, item_id, size, terms): each item with words, numbered, and its terms in their order."""
    own = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0)
    a, b = lambda q: F.get("w", q), lambda q: F.get("w", q + 1)

    def term(q: Column) -> Column:
        key, check = _keys(a(q), b(q))
        return F.struct(key.alias("key"), check.alias("check"), F.concat_ws(" ", a(q), b(q)).alias("term"))

    places = F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)))
    return own.select("item", "item_id", F.size("w").alias("size"), F.transform(places, term).alias("terms"))


def build_index(docs: DataFrame, items: DataFrame, n: int = 13, broadcast_rows: int = BROADCAST_ROWS, path: str | None = None) -> Index:
    """The stored index of docs for the terms of items: checkpointed, or written to path to be kept."""
    if n < 2:
        raise ValueError("n must be 2 or more: terms are pairs of words")
    known = checkpoint(item_rows(items))
    asked = known.select(F.explode("terms").alias("t")).select(F.col("t.key").alias("key")).distinct().withColumn("asked", F.lit(True))
    singles = not known.where("size = 1").isEmpty()
    size = F.size("w")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("w"))
    # places -1 to size - 2 for the document itself and its pairs; places beyond stand for single words
    last = F.greatest(size - 2, F.lit(-1)) + (size if singles else F.lit(0))
    spread = own.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    alone = F.col("at") > F.greatest(size - 2, F.lit(-1)) if singles else F.lit(False)
    p = F.when(alone, F.col("at") - F.greatest(size - 1, F.lit(0))).otherwise(F.col("at"))
    key, check = _keys(F.get("w", F.col("p")), F.when(~F.col("alone"), F.get("w", F.col("p") + 1)))
    placed = spread.withColumns({"p": p, "alone": alone})
    hashed = placed.select("row", "doc_id", size.alias("n_words"), "p", F.when(F.col("p") < 0, F.xxhash64("row")).otherwise(key).alias("key"), check.alias("check"))
    kept = hashed.join(bounded(asked, broadcast_rows), "key", "left").where("p < 0 OR asked").select("row", "doc_id", "n_words", "p", "key", "check")
    if path is None:
        return Index(checkpoint(kept), known, n, broadcast_rows)
    kept.write.mode("overwrite").parquet(path)
    return Index(docs.sparkSession.read.parquet(path), known, n, broadcast_rows)


def anchors(index: Index) -> DataFrame:
    """(item, q, key, check): the rarest term of every window, where all of its terms occur."""
    need = F.least(F.lit(index.n - 1), F.col("n_terms"))
    ahead = Window.partitionBy("item").orderBy("q").rowsBetween(0, index.n - 2)
    rarest = index.terms().withColumn("least", F.min(F.struct("f", "term", "q", "key", "check")).over(ahead)).where(F.col("q") + need <= F.col("n_terms"))
    return rarest.where("least.f > 0").select("item", "least.q", "least.key", "least.check").distinct()


def phrase_hits(index: Index) -> DataFrame:
    """(row, item_id, start, end): runs of document words, places from 0 and end exclusive, that occurrences of item windows cover."""
    few = index.broadcast_rows
    met = index.lists().join(bounded(reused(anchors(index)), few), ["key", "check"]).select("row", "item", (F.col("p") - F.col("q")).alias("offset")).distinct()
    met = reused(met)
    # every term of a candidate's item at the place where the document should have it; a document's places are not copied to candidates
    wanted = met.join(bounded(index.items, few // 50), "item").select("row", "item", "item_id", "size", F.size("terms").alias("n_terms"), "offset", F.posexplode("terms").alias("q", "t"))
    wanted = wanted.select("row", "item", "item_id", "size", "n_terms", "offset", (F.col("offset") + F.col("q")).alias("p"), "t.key", "t.check")
    own = index.lists().join(bounded(met.select("row").distinct(), few), "row", "left_semi")
    both = wanted.join(own, ["row", "p", "key", "check"]).groupBy("row", "item", "offset").agg(F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.first("n_terms").alias("n_terms"), F.array_sort(F.collect_set("p")).alias("found"))
    both = both.withColumn("need", F.least(F.lit(index.n - 1), "n_terms")).where(F.size("found") >= F.col("need"))
    starts = F.filter("found", lambda x, k: F.get("found", k + F.col("need") - 1) == x + F.col("need") - 1)
    both = both.select("row", "item_id", F.least(F.lit(index.n), F.col("size")).alias("width"), starts.alias("s")).where(F.size("s") > 0)
    first = F.filter("s", lambda x, k: (k == 0) | ~F.get("s", k - 1).eqNullSafe(x - 1))
    final = F.filter("s", lambda x, k: ~F.get("s", k + 1).eqNullSafe(x + 1))
    runs = both.select("row", "item_id", "width", F.explode(F.zip_with(first, final, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("r"))
    return runs.select("row", "item_id", F.col("r.a").cast("long").alias("start"), (F.col("r.b") + F.col("width")).cast("long").alias("end"))


def proximity_hits(index: Index, slop: int = 10) -> DataFrame:
    """(row, item_id, start, end): first words of an item's two rarest terms that stand within slop words of each other."""
    distinct = index.terms().groupBy("item", "item_id", "key", "check", "term", "f").agg(F.lit(1).alias("one"))
    of_item = Window.partitionBy("item")
    rank = F.row_number().over(of_item.orderBy(F.col("f") == 0, "f", "term"))
    rare = distinct.withColumns({"k": rank, "several": F.count("*").over(of_item) > 1}).where("k <= 2 AND f > 0").select("item", "item_id", "key", "check", "k", "several")
    lists = index.lists().join(bounded(reused(rare), index.broadcast_rows), ["key", "check"]).select("row", "item", "item_id", "k", "several", "p", F.floor(F.col("p") / slop).alias("band"))
    alone = lists.where("NOT several").select("row", "item_id", F.col("p").alias("start"), F.col("p").alias("end"))
    one = lists.where("k = 1 AND several").select("row", "item", "item_id", F.col("p").alias("p1"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    two = lists.where("k = 2").select("row", "item", F.col("p").alias("p2"), "band")
    near = one.join(two, ["row", "item", "band"]).where(F.abs(F.col("p1") - F.col("p2")) <= slop).select("row", "item_id", F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("end"))
    return alone.union(near).select("row", "item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()


def judge_documents(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, slop: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near); contaminated if 1 in `share` words or more is hit,
    n_near counts the items that match by proximity."""
    index = build_index(docs, items, n, broadcast_rows)
    hits = phrase_hits(index).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"), F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate("runs", none, lambda s, r: F.struct((s["covered"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["upto"]))).alias("covered"), F.greatest(s["upto"], r["end"]).alias("upto")), lambda s: s["covered"])
    found = hits.select("row", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("list"))
    near = proximity_hits(index, slop).select("row", "item_id").distinct().groupBy("row").agg(F.count("item_id").alias("n_near"))
    own = index.postings.where("p < 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    joined = own.join(found, "row", "left").join(near, "row", "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"))
