"""Pieces that several operators share: kept results, digests, hot groups and connected components."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.session import checkpoint

#: A side is broadcast only when a count has shown that it has at most so many narrow rows.
BROADCAST_ROWS = 200_000


def give_back() -> None:
    """Return what earlier tasks of this worker have freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def reused(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks for the several plans that read it; lost blocks are made again from its lineage."""
    return df.persist(StorageLevel.DISK_ONLY)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast if a count proves that they are few; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_hot(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Deal rows to groups (key, bi, bj) so that every pair of one key's rows meets in exactly one group.

    A key of at most `limit` rows is the one group (key, 0, 0). A larger one is cut into nb blocks by a hash
    of `member`; block b goes to the groups (min(b, j), max(b, j)) for all j, so no group exceeds about
    2 * limit rows, whatever share of all rows the key holds. Within a group with bi < bj only pairs across
    the two blocks are to be looked at; the added column `blk` says which one a row belongs to.
    """
    hot = df.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("nb"))
    hot = reused(hot)
    if hot.isEmpty():
        zero = F.lit(0)
        return df.select("*", zero.alias("blk"), zero.alias("bi"), zero.alias("bj"))
    nb = F.coalesce(F.col("nb"), F.lit(1))
    dealt = df.join(bounded(hot), key, "left").withColumn("blk", F.pmod(F.xxhash64(F.col(member), F.lit(7)), nb).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    return dealt.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("nb", "other")


def components(edges: DataFrame, each: int = 100_000) -> DataFrame:
    """Connected components of edges (a, b) as (node, component), component being the smallest node.

    Alternates the large-star and small-star steps until nothing changes, which takes about the logarithm of the longest
    path; each round is two aggregations with map-side minima and a join, cut by a checkpoint of one file for `each` edges.
    Nodes without edges do not appear.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = checkpoint(pairs)  # a round reads them eight times, and each would carry the plan that found them
    size = pairs.count()
    if not size:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    files = -(-size // each)
    while True:
        # large star: neighbours above u go to the smallest node of u's neighbourhood
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its lower neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(files))
        # done when every node has one neighbour, which is nobody's upper node: one look at all nodes, once as upper and once as lower
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
        if seen.where("up > 1 OR (up > 0 AND low = 0)").isEmpty():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# Documents are dealt to blocks by doc_id; what a block wants to know of the corpus it asks of the buckets that own
# ranges of 64-bit keys, and the buckets answer block by block. A key that stands in a third of all documents then
# reaches its bucket once for each block, however often it occurs. There are as many blocks and buckets as the corpus has
# bytes for, whatever the number of partitions, and no message is sent without keys in it.

BLOCK_BYTES = 8_000_000


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0


def parts_of(total: int, each: int = BLOCK_BYTES) -> int:
    return max(1, -(-total // each))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, text), to be grouped by block; plans that group it share one shuffle of the texts.

    Rows without an id are dealt by their texts, so that no block gets all of them.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return typed.select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")


def bucket_bounds(buckets: int) -> np.ndarray:
    """The least key of each bucket but the first: equal ranges of the 64-bit keys."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, so that shuffle compression drops the empty planes."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(values: np.ndarray) -> bytes:
    """Signed 64-bit values byte plane by byte plane, in their order."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts byte plane by byte plane, entropy-coded: most are small."""
    return len(counts).to_bytes(4, "little") + pa.compress(pack_ints(counts), codec="zstd", asbytes=True)


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack_ints(pa.decompress(data[4:], 8 * int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True))


def rows_of(table: pa.Table) -> tuple[int, list[int | None], list[bytes]]:
    """Block number, doc_ids and texts (UTF-8, null as empty) of one block, in an order that does not hang on the shuffle's."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] or b""))
    return table.column("block")[0].as_py(), [ids[k] for k in order], [texts[k] or b"" for k in order]


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys (two multiply-xorshift rounds)."""
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(32))


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least connected row, as far as known) after joining rows a[k] and b[k]."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[labels]
        if np.array_equal(new, labels):
            return labels
        labels = new


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size): a sort of the rows by the columns, and where each run of equal rows starts in it and how long it is."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(change)
    return order, first, np.diff(np.r_[first, len(order)])
