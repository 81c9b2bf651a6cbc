"""Spelling variants: words that differ by one edit, found by the halves that they share, and the common form of each.

A word is cut in two halves. One edit leaves one of them as it was, so a word that is one edit away from it starts with
its first half or ends with its second. Shards own segments (halves) by hash; the Aho-Corasick automaton of a shard
holds its segments, every word that may hold one of them is scanned, and a match counts if its place (start or end) and
the lengths of the two words agree. What is left of the two words after the common half is then held against each other
through signatures (the rest, and the rest with one place open), so that a segment that very many words share costs
their number and not its square; the distance of what is found is verified.

A segment of more than HOT_SEGMENT words is dealt on by signature, so that no shard gets all of its words.

Defined cases: a null or empty text has no words, a null doc_id is an empty string before the colon of the draw, rows
that repeat a doc_id or a text count each; without words the result is empty; extra columns are ignored; of near words
with the same count the first in code-point order is the form.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import checkpoint, parts_of, reused

#: The runs that count as words, and what is lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: every so many draws a run loses one of its code points.
DRAW = 97
#: Words of one segment that are dealt on by signature, and rows for each shard.
HOT_SEGMENT, SHARD_ROWS, SHARD_BYTES = 20_000, 60_000, 16_000_000
#: Code points of what is left of a word beyond which it is known by hashes, and dealt by its ends.
LONG_REST = 64
HOLDS_FIRST, HOLDS_SECOND, ASKS = 0, 1, 2


def misspelt(doc_id: Column, run: Column, draw: int = DRAW) -> Column:
    """run, without one code point where the crc32 of `<doc_id>:<run>` says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % draw == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words_of(docs: DataFrame, min_chars: int = 5, min_count: int = 3, draw: int = DRAW) -> DataFrame:
    """(word, n): words of whole texts of min_chars code points or more that occur min_count times or more."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.col("doc_id").alias("id"), F.explode(runs).alias("run"))
    counted = each.select(misspelt(F.col("id"), F.col("run"), draw).alias("word")).where(F.char_length("word") >= min_chars)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def halves(word: Column, length: Column) -> tuple[Column, Column]:
    """The first half of a word of this length, and the second, as they would lie at the start and the end of `word`."""
    first = F.floor(length / 2).cast("int")
    rest = (length - first).cast("int")
    return F.substring(word, F.lit(1), first), F.substring(word, F.char_length(word) - rest + 1, rest)


def _rest(side: Column, segment: Column, word: Column) -> Column:
    k, n = F.char_length(segment), F.char_length(word)
    return F.when(side == HOLDS_FIRST, F.substring(word, k + 1, n)).otherwise(F.substring(word, F.lit(1), n - k))


def _without_each(rest: Column, mark: str) -> Column:
    """rest, with each code point in turn replaced by mark."""
    return F.transform(F.sequence(F.lit(1), F.char_length(rest)), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.lit(mark), F.substring(rest, i + 1, F.char_length(rest))))


def _ends(rest: Column) -> Column:
    """Both ends of a long rest: one edit leaves one of them as it is."""
    return F.array(F.concat(F.lit("<"), F.substring(rest, F.lit(1), F.lit(LONG_REST // 2))), F.concat(F.lit(">"), F.substring(rest, F.lit(-(LONG_REST // 2)), F.lit(LONG_REST // 2))))


def signatures(side: Column, segment: Column, word: Column) -> Column:
    """What a word keeps besides a segment: the rest, and the rest with each place open in turn; the ends of a long rest."""
    rest = _rest(side, segment, word)
    return F.when(F.char_length(rest) > LONG_REST, _ends(rest)).otherwise(F.array_append(_without_each(rest, "\0"), rest))


def asked_signatures(side: Column, segment: Column, word: Column) -> Column:
    """Those that words of the same length may share with this one, and those that words shorter by one may."""
    rest = _rest(side, segment, word)
    size = F.char_length(rest)
    none = F.array().cast("array<string>")
    same = F.when(size > LONG_REST, _ends(rest)).otherwise(_without_each(rest, "\0"))
    shorter = F.when(size > LONG_REST + 1, none).otherwise(_without_each(rest, ""))
    return F.array_distinct(F.concat(same, shorter))


#: A prime modulus and a base of the hashes of long rests; what they find is verified.
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def _hash(rest: str) -> int:
    h = 0
    for c in rest:
        h = (h * BASE + ord(c)) % MODULUS
    return h


def whole(rest: str) -> str | int:
    """A rest as a key: itself, or its hash if it is long."""
    return rest if len(rest) <= LONG_REST else _hash(rest)


def without_each(rest: str) -> list[str] | list[int]:
    """The keys of rest without each of its code points, in time proportional to a long rest's length."""
    n = len(rest)
    if n - 1 <= LONG_REST:
        return [rest[:i] + rest[i + 1 :] for i in range(n)]
    before, h = [], 0
    for c in rest:
        before.append(h)
        h = (h * BASE + ord(c)) % MODULUS
    keys, after, power = [0] * n, 0, 1
    for i in range(n - 1, -1, -1):
        keys[i] = (before[i] * power + after) % MODULUS
        after, power = (ord(rest[i]) * power + after) % MODULUS, power * BASE % MODULUS
    return keys


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short = min(len(a), len(b))
    k = next((i for i in range(short) if a[i] != b[i]), short)
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _near_in_shard(table: pa.Table) -> pa.Table:
    """Pairs (word, near, near_n) that the segments of one shard show: both ways for words of two lengths, which the longer one finds."""
    words, counts, roles = (table.column(c).to_pylist() for c in ("word", "n", "role"))
    number: dict[str, int] = {}
    held: dict[tuple[int, int, str | int], list[int]] = {}  # by segment and side, the place that is open (-1: none), and what is left
    for k, (word, role) in enumerate(zip(words, roles, strict=True)):
        if role == ASKS:
            continue
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if role == HOLDS_FIRST else (word[half:], word[:half])
        own = number.setdefault(segment, len(number)) * 2 + role
        held.setdefault((own, -1, whole(rest)), []).append(k)
        for i, left in enumerate(without_each(rest)):
            held.setdefault((own, i, left), []).append(k)
    found: set[tuple[int, int]] = set()
    if number:
        automaton = ahocorasick.Automaton()
        for segment, own in number.items():
            automaton.add_word(segment, (own, len(segment)))
        automaton.make_automaton()
        for k, (word, role) in enumerate(zip(words, roles, strict=True)):
            if role != ASKS:
                continue
            m = len(word)
            for end, (own, size) in automaton.iter(word):
                for side in (HOLDS_FIRST, HOLDS_SECOND):
                    if (end + 1 != size) if side == HOLDS_FIRST else (end + 1 != m):
                        continue
                    rest = word[size:] if side == HOLDS_FIRST else word[: m - size]
                    lengths = [n for n in (m - 1, m) if size == (n // 2 if side == HOLDS_FIRST else n - n // 2)]  # a longer word finds this one
                    if lengths:
                        for i, left in enumerate(without_each(rest)):
                            for n in lengths:
                                found.update((k, o) for o in held.get((own * 2 + side, i if n == m else -1, left), ()) if len(words[o]) == n and one_edit(word, words[o]))
    pairs = {(words[a], words[b], counts[b]) for a, b in found} | {(words[b], words[a], counts[a]) for a, b in found if len(words[a]) != len(words[b])}
    return pa.table([pa.array(x, t) for x, t in zip(zip(*pairs) if pairs else [()] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])


def near_words(vocabulary: DataFrame, hot: int = HOT_SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, near, near_n) for every two words of (word, n), n being unique to a word, that are one edit apart, both ways."""
    length = F.char_length("word")
    first, second = halves(F.col("word"), length)
    own = F.array(F.struct(F.lit(HOLDS_FIRST).alias("side"), first.alias("segment")), F.struct(F.lit(HOLDS_SECOND).alias("side"), second.alias("segment")))
    holders = vocabulary.select("word", "n", F.explode(own).alias("s")).select("word", "n", "s.side", "s.segment", F.col("s.side").alias("role"))
    asked = []
    for less in (0, 1):
        first, second = halves(F.col("word"), length - less)
        asked += [F.struct(F.lit(HOLDS_FIRST).alias("side"), first.alias("segment")), F.struct(F.lit(HOLDS_SECOND).alias("side"), second.alias("segment"))]
    asking = vocabulary.select("word", "n", F.explode(F.array_distinct(F.array(*asked))).alias("s")).select("word", "n", "s.side", "s.segment", F.lit(ASKS).alias("role"))
    size, chars = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    shards = max(parts_of(6 * size, shard_rows), parts_of(6 * chars, SHARD_BYTES))
    crowded = reused(holders.groupBy("side", "segment").count().where(F.col("count") > hot).select("side", "segment"))
    rows = holders.unionByName(asking)
    if not crowded.isEmpty():  # at most size / hot segments
        rows = rows.join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), ["side", "segment"], "left")
        sides = (F.col("side"), F.col("segment"), F.col("word"))
        signs = F.when(F.col("role") == ASKS, asked_signatures(*sides)).otherwise(signatures(*sides))
        rows = rows.withColumn("sign", F.explode(F.when(F.col("crowded"), signs).otherwise(F.array(F.lit(None).cast("string"))))).drop("crowded")
        place = F.xxhash64("side", "segment", "sign")
    else:
        place = F.xxhash64("side", "segment")
    dealt = rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), "word", "n", "role").distinct()
    return dealt.groupBy("shard").applyInArrow(_near_in_shard, "word string, near string, near_n long").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to (word, form, ...): the last word that forms lead to. Forms lead to ever larger counts, so they end.

    Each round doubles the steps that are known, and reads only words that have a form.
    """
    steps = checkpoint(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = checkpoint(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, draw: int = DRAW) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the corpus."""
    vocabulary = reused(words_of(docs, min_chars, min_count, draw))
    near = near_words(vocabulary)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    largest = -F.col("best.less")
    common = F.col("best").isNotNull() & (largest >= ratio * F.col("n"))
    forms = vocabulary.join(told, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, largest).alias("form_n")
    )
    return with_roots(reused(forms)).select("word", "form", "root", "n", "n_near", "form_n")
