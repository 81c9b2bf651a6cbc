"""Stupid-backoff language-model scores from n-gram count tables that are partitioned by hash.

The score of a word after a context is its relative count where that n-gram was seen, else `alpha` times the score
after the context without its first word, down to the share of the word among all words. A document's score is the
sum of the natural logarithms over its words; the counts come from every document of the corpus.

Texts are read once: each task turns its documents into blocks of about BLOCK_BYTES of text, kept as word numbers with
the block's vocabulary (64-bit hashes). A count table of each order lies in buckets, equal ranges of the n-gram hashes,
as many as the corpus has words for (BUCKET_WORDS). A block sends a bucket its distinct n-grams of that range with how
often it has them; the bucket adds up what all blocks sent, which is its part of the count table, and joins it back to
what each block asked; the block joins the counts to its exploded n-grams and sums by document. A common n-gram
reaches a bucket once for each block, however often it occurs, and no message is sent without n-grams in it.

Words are runs of letters, digits and characters beyond ASCII, in lower case (A-Z only). Defined cases: a null text
or one without words has no words, score 0 and a null mean; rows that repeat a doc_id or have none count as documents of
their own; a text longer than a block is a block of its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import bucket_bounds, checkpoint, mix, pack_counts, pack_sorted, unpack_counts, unpack_sorted

#: Bytes of text in a block, and words of the corpus for each bucket of a count table.
BLOCK_BYTES, BUCKET_WORDS = 16_000_000, 2_000_000
RESULT = "doc_id long, n_words long, log_score double, mean_log_score double"
BLOCKS = "block long, doc_ids array<long>, sizes array<int>, vocabulary binary, words binary, n_words long"

#: What turns a text into words between spaces: A-Z to lower case, other ASCII than letters and digits to spaces.
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if c < 0x80 and chr(c).isupper() else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the number of each word in them, one text after another, and how many each text has."""
    known, parts, sizes = _Numbers(), [np.zeros(0, np.uint32)], []
    for text in texts:
        words = split_words(text)
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        sizes.append(len(words))
    return known.hashes(), np.concatenate(parts), np.array(sizes, np.int64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and how many each text has."""
    hashes, numbers, sizes = numbered_words(texts)
    return hashes[numbers], sizes


def longer(grams: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams ending at each word: the gram of n-1 ending one earlier, then this word."""
    return mix(mix(np.r_[np.zeros(1, np.uint64), grams[:-1]][: len(words)] + np.uint64(n)) ^ words)


def gram_place(sizes: np.ndarray) -> np.ndarray:
    """The place of each word within its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: the hash of the n-gram that ends at each word and where it lies within one text."""
    place, grams, own = gram_place(sizes), [], words
    for n in range(1, order + 1):
        if n > 1:
            own = longer(own, words, n)
        grams.append((own, place >= n - 1))
    return grams


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the count of each."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, compressed: frequent words have low numbers."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def read_blocks(docs: DataFrame) -> DataFrame:
    """The tokenised corpus (BLOCKS), one row for each block, cut off from the texts by a checkpoint."""

    def block(ids: list[int | None], texts: list[bytes], number: int) -> pa.RecordBatch:
        hashes, numbers, sizes = numbered_words(texts)
        place = TaskContext.get().partitionId() << 32 | number
        columns = [pa.array([place]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([hashes.astype("<u8").tobytes()], pa.binary()), pa.array([_planes(numbers)], pa.binary()), pa.array([len(numbers)])]
        return pa.record_batch(columns, names=["block", "doc_ids", "sizes", "vocabulary", "words", "n_words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py() or b""
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block(ids, texts, number)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i), texts.append(text)
                size += len(text)
        if texts:
            yield block(ids, texts, number)

    return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, BLOCKS))


class _Block:
    """One block's n-grams with the corpus counts that it has been told so far."""

    def __init__(self, row: dict, told: dict[int, list[bytes]], order: int):
        self.block, self.ids, self.sizes = row["block"], row["doc_ids"], np.array(row["sizes"], np.int64)
        own = words = np.frombuffer(row["vocabulary"], "<u8")[_numbers(row["words"], row["n_words"])]
        self.words, self.place = len(words), gram_place(self.sizes)
        self.counts: list[np.ndarray] = []
        self.open = np.zeros(0, np.uint64)  # the hashes to be asked next
        for n in range(1, order + 1):
            if n > 1:
                own = longer(own, words, n)
            wanted = self.place >= n - 1
            if n > 1:  # an n-gram occurs once if either part of it does, and need not be asked for
                last = self.counts[-1] > 1
                wanted &= last & np.r_[False, last[:-1]][: len(last)]
            asked = own[wanted]
            if n not in told and len(asked):
                self.open = asked
                return
            count = np.where(self.place >= n - 1, 1, 0).astype(np.int64)
            if len(asked):
                keys, _ = _unique(asked)
                count[wanted] = np.concatenate([unpack_counts(x) for x in told[n]])[np.searchsorted(keys, asked)]
            self.counts.append(count)


def _told(replies: pa.Table | None) -> dict[int, list[bytes]]:
    """What the buckets answered for each order, in the order of the buckets."""
    told: dict[int, list[tuple[int, bytes]]] = {}
    if replies is not None:
        for n, bucket, totals in zip(replies.column("n").to_pylist(), replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True):
            told.setdefault(n, []).append((bucket, totals))
    return {n: [x for _, x in sorted(own)] for n, own in told.items()}


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) under the model that all of docs make.

    Counts are asked for in rounds, from words to the longest n-grams: one that holds a part that occurs once in
    the corpus occurs once itself, so most long n-grams are known without being sent.
    """
    blocks = read_blocks(docs)
    corpus = blocks.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    lower = bucket_bounds(-(-corpus // BUCKET_WORDS) or 1)
    asked_names = ["bucket", "block", "keys", "counts"]
    asked_kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def messages(own: _Block) -> pa.Table:
        keys, counts = _unique(own.open)
        cuts = [0, *np.searchsorted(keys, lower).tolist(), len(keys)]
        out = [(k, own.block, pack_sorted(keys[a:b]), pack_counts(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, asked_kinds, strict=True)], names=asked_names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from messages(_Block(batch.slice(k, 1).to_pylist()[0], {}, 1)).to_batches()

    def ask(table: pa.Table, replies: pa.Table, n: int) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in asked_kinds], names=asked_names)
        return messages(_Block(table.to_pylist()[0], _told(replies), n))

    def answer(table: pa.Table, n: int) -> pa.Table:
        """The bucket's part of the count table, joined back to what each block asked, in the order in which it asked."""
        bucket, rows = table.column("bucket")[0].as_py(), sorted(zip(table.column("block").to_pylist(), table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True), key=lambda r: r[0])
        keys, counts = [unpack_sorted(r[1]) for r in rows], np.concatenate([unpack_counts(r[2]) for r in rows])
        cuts = np.cumsum([0, *map(len, keys)])
        every = np.concatenate(keys)
        del keys
        by = np.argsort(every, kind="stable")
        head = np.r_[True, every[by[1:]] != every[by[:-1]]]
        del every
        sums = np.add.reduceat(counts[by], np.flatnonzero(head))
        totals = np.empty(len(by), np.int64)
        totals[by] = sums[np.cumsum(head) - 1]
        out = [(r[0], bucket, n, pack_counts(totals[a:b])) for r, a, b in zip(rows, cuts, cuts[1:])]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "n", "totals"])

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        own = _Block(table.to_pylist()[0], _told(replies), order)
        best = own.counts[0] / max(1, corpus)
        for n in range(1, order):  # a longer context wins where its n-gram was seen
            context = np.r_[np.zeros(1, np.int64), own.counts[n - 1][:-1]][: own.words]
            backed = np.where(own.place >= n, alpha * best, best)
            best = np.where(own.counts[n] > 0, own.counts[n] / np.maximum(1, context), backed)
        logs, sizes = np.log(best), own.sizes
        ends = np.cumsum(sizes)
        sums = [float(logs[b - s : b].sum()) for s, b in zip(sizes, ends)]
        return pa.table([pa.array(own.ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array([x / s if s else None for x, s in zip(sums, sizes.tolist())], pa.float64())], names=names)

    def asking(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda table, replies: ask(table, replies, n)

    def answering(n: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: answer(table, n)

    names = ["doc_id", "n_words", "log_score", "mean_log_score"]
    replies = None
    for n in range(1, order + 1):
        kinds = "bucket int, block long, keys binary, counts binary"
        asked = blocks.mapInArrow(first, kinds) if replies is None else blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(asking(n), kinds)
        told = asked.groupBy("bucket").applyInArrow(answering(n), "block long, bucket int, n int, totals binary")
        replies = told if replies is None else replies.union(told)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, RESULT)
