"""Phrase collocations from vertical inverted lists: exact frequencies of contiguous phrases, level by level.

Texts are read once into blocks. A block keeps, for each frequent phrase, the list of places where it occurs in it; the
phrases of one word more come from merge-joining these lists, moved on by the phrase's length, with the postings of
the adjacent words. The length of a list is the phrase's exact frequency in the block, and buckets that own the phrases
by hash add up the lengths of all blocks, number the frequent phrases and answer each block which of its lists
go on. A phrase is sent only if its first and its last part are frequent, and as two numbers, that of its prefix
phrase and that of its last word, so nothing hangs on hashes being different. A common phrase reaches its bucket once
for each block, however often it occurs.

What is frequent is then a table; parts, cuts and scores are joins and aggregations on it. Scores are exact: products are
decimals of 38 digits.

Words are runs without space and tab within pieces, which end at `.,;:!?` and line ends; only A-Z are lower-cased. Defined
cases: a null text is empty, a null lang is `und`, doc_id is not looked at, so rows without one or with the same one
count each; an empty table or one without frequent phrases has no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import bounded, checkpoint, mix, pack_counts, pack_ints, pack_sorted, reused, runs_of, unpack_counts, unpack_ints, unpack_sorted

#: Bytes of text in a block, and words of the corpus for each bucket.
BLOCK_BYTES, BUCKET_WORDS = 16_000_000, 2_000_000
UNKNOWN = "und"
#: Parts into which a language's candidates are dealt before its first ranks are told.
RANK_PARTS = 64
#: What ends a piece, and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CUT = bytes(0x0A if c in ENDS else 0x20 if c in BLANKS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

BLOCKS = "block long, n int, words binary, langs array<string>, sizes array<int>, vocabulary binary"
#: A block's distinct phrases of one level with their local frequencies; at the first level words, after it pairs of numbers.
ASKED = "bucket int, block long, keys binary, counts binary, langs array<string>, sizes array<int>"
#: What a bucket says: to each block the numbers of what it asked (block is set), and once its part of the table (block is null).
TOLD = "block long, bucket int, ids binary, keys binary, counts binary, langs array<string>, sizes array<int>, totals array<long>"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


class _Words(dict):
    """Numbers of one language's words within a block; 0 ends a piece and -1 is nothing."""

    def __init__(self, every: list[int]):
        super().__init__({b"": -1, b"\n": 0})
        self.every = every

    def __missing__(self, word: bytes) -> int:
        self.every[0] += 1
        self[word] = self.every[0]
        return self.every[0]

    def in_order(self) -> list[bytes]:
        return list(self)[2:]


def read_blocks(docs: DataFrame) -> DataFrame:
    """The corpus as word numbers (BLOCKS): each language's words of the block, joined by spaces, and every word's number."""

    def block(rows: list[tuple[str, bytes]], number: int) -> pa.Table:
        known: dict[str, _Words] = {}
        every, parts = [0], []
        for lang, text in rows:
            own = known.setdefault(lang, _Words(every))
            tokens = text.translate(_CUT).replace(b"\n", b" \n ").split(b" ")
            parts.append(np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens)))
            parts.append(np.zeros(1, np.int32))
        found = np.concatenate(parts)
        found = found[found >= 0]
        langs = list(known)
        # numbers go language by language
        order = np.argsort(np.concatenate([np.fromiter((k for k in known[x].values() if k > 0), np.int64) for x in langs]))
        renumber = np.r_[0, order + 1]
        place = TaskContext.get().partitionId() << 32 | number
        vocabulary = b" ".join(w for x in langs for w in known[x].in_order())
        return _table([(place, len(found), pack_counts(renumber[found]), langs, [len(known[x]) - 2 for x in langs], vocabulary)], BLOCKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, number = [], 0, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py() or b""
                if rows and size + len(text) > BLOCK_BYTES:
                    yield from block(rows, number).to_batches()
                    rows, size, number = [], 0, number + 1
                rows.append((lang, text))
                size += len(text)
        if rows:
            yield from block(rows, number).to_batches()

    typed = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return checkpoint(typed.mapInArrow(read, BLOCKS))


def _vocabulary(row: dict) -> tuple[list[str], list[bytes]]:
    """The language and the bytes of each word of a block, in the order of their numbers."""
    return [x for x, n in zip(row["langs"], row["sizes"], strict=True) for _ in range(n)], row["vocabulary"].split(b" ") if sum(row["sizes"]) else []


def _buckets_of_words(langs: list[str], words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode() + b"\t" + w) % buckets for x, w in zip(langs, words, strict=True)), np.int64, len(words))


def _asked_words(row: dict, buckets: int) -> Iterator[tuple]:
    langs, words = _vocabulary(row)
    counts = np.bincount(unpack_counts(row["words"]), minlength=len(words) + 1)[1:]
    of = _buckets_of_words(langs, words, buckets)
    order, first, size = runs_of(of, np.repeat(np.arange(len(row["langs"])), row["sizes"]))
    by_bucket: dict[int, list[np.ndarray]] = {}
    for a, n in zip(first, size, strict=True):
        by_bucket.setdefault(int(of[order[a]]), []).append(order[a : a + n])
    for bucket, groups in by_bucket.items():
        own = np.concatenate(groups)
        yield bucket, row["block"], b" ".join(words[k] for k in own), pack_counts(counts[own]), [langs[g[0]] for g in groups], [len(g) for g in groups]


def _told_words(table: pa.Table, buckets: int, min_count: int) -> pa.Table:
    """Sum the words of one bucket, number those that occur min_count times, and answer every block in its order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    bucket, total, n_lang = rows[0]["bucket"], {}, {}
    for r in rows:
        counts, words = unpack_counts(r["counts"]).tolist(), r["keys"].split(b" ")
        r["own"] = list(zip((x for x, n in zip(r["langs"], r["sizes"], strict=True) for _ in range(n)), words, strict=True))
        for key, n in zip(r["own"], counts, strict=True):
            total[key] = total.get(key, 0) + n
            n_lang[key[0]] = n_lang.get(key[0], 0) + n
    frequent = sorted(key for key, n in total.items() if n >= min_count)
    number = {key: k * buckets + bucket + 1 for k, key in enumerate(frequent)}
    out = [(r["block"], bucket, pack_counts(np.array([number.get(key, 0) for key in r["own"]], np.int64)), None, None, None, None, None) for r in rows]
    langs = sorted(n_lang)
    sizes = [sum(1 for x, _ in frequent if x == lang) for lang in langs]
    ids, counts = np.fromiter(number.values(), np.int64, len(number)), np.array([total[key] for key in frequent], np.int64)
    out.append((None, bucket, pack_counts(ids), b" ".join(w for _, w in frequent), pack_counts(counts), langs, sizes, [n_lang[x] for x in langs]))
    return _table(out, TOLD)


def _encode(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """A block's words under the corpus's numbers, 0 for what is not frequent or ends a piece; runs of 0 are one 0."""
    kinds = "block long, n int, ids binary"
    if not table.num_rows:
        return _table([], kinds)
    row = table.to_pylist()[0]
    langs, words = _vocabulary(row)
    told = dict(zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist(), strict=True))
    ids = np.zeros(len(words) + 1, np.int64)
    of = _buckets_of_words(langs, words, buckets)
    order, _, _ = runs_of(of, np.repeat(np.arange(len(row["langs"])), row["sizes"]))
    if len(order):
        ids[1 + order] = np.concatenate([unpack_counts(told[b]) for b in np.unique(of).tolist()])
    found = ids[unpack_counts(row["words"])]
    found = found[(found > 0) | np.r_[True, found[:-1] > 0][: len(found)]]
    return _table([(row["block"], len(found), pack_counts(found))], kinds)


def _extended(places: np.ndarray, ids: np.ndarray, words: np.ndarray, size: int, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of the occurrences (sorted places, phrase numbers) of phrases of `size` words with the postings of the words that
    follow: the places that go on with a frequent word and whose next place starts a frequent phrase too, and their keys."""
    follows = np.zeros(len(places), bool)
    follows[:-1] = places[1:] == places[:-1] + 1  # without its first word the longer phrase is frequent
    places, ids = places[follows], ids[follows]
    last = words[places + size]  # the posting at that place: it ends the phrase that starts one later, so it is frequent
    if len(ids) and int(ids.max()).bit_length() + word_bits > 64:
        raise OverflowError("numbers of phrases and words do not fit 64 bits")
    return places, ids.astype(np.uint64) << np.uint64(word_bits) | last.astype(np.uint64)


def _asked_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their buckets, counts, the index of each key): the lists of one level in the order in which they are asked."""
    distinct, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    bucket = ((mix(distinct) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return distinct[order], bucket[order], counts[order], back[index]


def _open_lists(row: dict, told: dict[int, dict[int, bytes]], level: int, buckets: int, word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of `level` words that the block asks for: keys, buckets and list lengths."""
    words = unpack_counts(row["ids"])
    places = np.flatnonzero(words)
    ids = words[places]
    for size in range(1, level):
        places, keys = _extended(places, ids, words, size, word_bits)
        distinct, bucket, counts, index = _asked_order(keys, buckets)
        if size + 1 == level:
            return distinct, bucket, counts
        numbers = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(told[size + 1][b]) for b in np.unique(bucket).tolist())])
        ids = numbers[index]
        places, ids = places[ids > 0], ids[ids > 0]
    raise ValueError(f"no level {level}")


def _asked_phrases(row: dict, told: dict[int, dict[int, bytes]], level: int, buckets: int, word_bits: int) -> Iterator[tuple]:
    keys, bucket, counts = _open_lists(row, told, level, buckets, word_bits)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            yield b, row["block"], pa.compress(pack_sorted(keys[a:z]), codec="zstd", asbytes=True), pack_counts(counts[a:z]), None, None


def _told_phrases(table: pa.Table, buckets: int, min_count: int) -> pa.Table:
    """Sum the list lengths of one bucket's phrases, number the frequent ones, and answer every block in its order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    bucket = rows[0]["bucket"]
    counts = [unpack_counts(r["counts"]) for r in rows]
    keys = [unpack_sorted(pa.decompress(r["keys"], 8 * len(c), codec="zstd", asbytes=True)) for r, c in zip(rows, counts, strict=True)]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, index, np.concatenate(counts))
    frequent = total >= min_count
    number = np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket + 1, 0)
    cuts = np.cumsum([0, *map(len, keys)])
    out = [(r["block"], bucket, pack_counts(number[index[a:z]]), None, None, None, None, None) for r, a, z in zip(rows, cuts, cuts[1:])]
    out.append((None, bucket, pack_counts(number[frequent]), pack_ints(distinct[frequent].view(np.int64)), pack_counts(total[frequent]), None, None, None))
    return _table(out, TOLD)


def _replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    told: dict[int, dict[int, bytes]] = {}
    for level, bucket, ids in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("ids").to_pylist(), strict=True):
        told.setdefault(level, {})[bucket] = ids
    return told


def frequent_phrases(docs: DataFrame, max_words: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f, head, tail): every phrase of 1 to max_words words with its exact frequency of min_count or more, and
    what it is without its last and its first word; and (lang, n): all words of each language."""
    blocks = read_blocks(docs)
    buckets = max(1, -(-(blocks.agg(F.sum("n").alias("n")).first()["n"] or 0) // BUCKET_WORDS))

    def of_blocks(asked: Callable[[dict], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from _table(list(asked(batch.slice(k, 1).to_pylist()[0])), ASKED).to_batches()

        return run

    said = reused(blocks.mapInArrow(of_blocks(lambda row: _asked_words(row, buckets)), ASKED).groupBy("bucket").applyInArrow(lambda t: _told_words(t, buckets, min_count), TOLD))
    answers = said.where(F.col("block").isNotNull()).select("block", "bucket", "ids")
    encoded = checkpoint(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, r: _encode(t, r, buckets), "block long, n int, ids binary"))
    table = said.where(F.col("block").isNull())
    words = reused(table.mapInArrow(_word_rows, "id long, lang string, phrase string, f long"))
    totals = table.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    word_bits = int(words.agg(F.max("id").alias("m")).first()["m"] or 1).bit_length()

    replies, levels = None, [words.select("id", "lang", F.lit(1).alias("size"), "phrase", "f", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail"))]
    for level in range(2, max_words + 1):
        if replies is None:
            asked = encoded.mapInArrow(of_blocks(lambda row: _asked_phrases(row, {}, 2, buckets, word_bits)), ASKED)
        else:
            asked = encoded.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_asking(level, buckets, word_bits), ASKED)
        said = reused(asked.groupBy("bucket").applyInArrow(lambda t: _told_phrases(t, buckets, min_count), TOLD))
        answers = said.where(F.col("block").isNotNull()).select("block", "bucket", "ids", F.lit(level).alias("level"))
        replies = answers if replies is None else replies.union(answers)
        pairs = said.where(F.col("block").isNull()).mapInArrow(_phrase_rows(word_bits), "id long, head_id long, last_id long, f long")
        heads = levels[-1].select(F.col("id").alias("head_id"), "lang", F.col("phrase").alias("head"))
        lasts = words.select(F.col("id").alias("last_id"), F.col("phrase").alias("last"))
        met = pairs.join(bounded(heads), "head_id").join(bounded(lasts), "last_id")
        phrase = F.concat_ws(" ", "head", "last")
        levels.append(checkpoint(met.select("id", "lang", F.lit(level).alias("size"), phrase.alias("phrase"), "f", "head", F.expr("substr(concat_ws(' ', head, last), instr(head || ' ', ' ') + 1)").alias("tail"))))
    every = levels[0]
    for own in levels[1:]:
        every = every.union(own)
    return every.drop("id"), totals


def _asking(level: int, buckets: int, word_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return _table([m for row in rows for m in _asked_phrases(row, _replies(replies), level, buckets, word_bits)], ASKED)

    return ask


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_counts(r["ids"])
            langs = [x for x, n in zip(r["langs"], r["sizes"], strict=True) for _ in range(n)]
            words = [w.decode("utf-8", "replace") for w in r["keys"].split(b" ")] if langs else []
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(unpack_counts(r["counts"]), pa.int64())], names=["id", "lang", "phrase", "f"])


def _phrase_rows(word_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_ints(r["keys"]).view(np.uint64)
                head, last = (keys >> np.uint64(word_bits)).astype(np.int64), (keys & np.uint64((1 << word_bits) - 1)).astype(np.int64)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (unpack_counts(r["ids"]), head, last, unpack_counts(r["counts"]))], names=["id", "head_id", "last_id", "f"])

    return run


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two words or more of each language by the score of their weakest cut.

    A phrase that stands in no other company than a longer frequent one is dropped. Since no phrase is more frequent
    than its parts, it is enough to look one word further.
    """
    found, totals = frequent_phrases(docs, max_words, min_count)
    found = reused(found)
    longer = found.where("size > 2")
    around = longer.select("lang", F.col("head").alias("phrase"), "f").union(longer.select("lang", F.col("tail").alias("phrase"), "f")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    own = found.where("size > 1").join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("f"))).select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = found.select("lang", F.col("phrase").alias("part"), "f")
    sides = bounded(counts)
    met = cuts.join(sides.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    met = met.join(sides.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(bounded(totals), "lang")
    score = F.expr("(cast(a as decimal(17, 0)) * cast(1000 as decimal(4, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))")
    weakest = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = scored.withColumn("part", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    ranked = first.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
