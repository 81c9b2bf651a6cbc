"""N-gram Jaccard join: an LSH forest of MinHash signatures, then exact verification.

Documents with equal sets of word shingles are one class and are looked at once. Each class has a signature for each of
TREES tries. A trie's task sorts its signatures: classes under one node share a prefix. The prefix that has to match is
shortened, from the longest, until a pair of the least wanted similarity meets in some trie with the target probability
(`prefix_length`); as a join wants every pair, that length is one for all lookups and the tries are cut there, and longer
matches only come first where a node is large. Under a node, one-bit sketches rule out pairs that are far below the
threshold; what remains joins candidate groups, as a spanning forest, never as pairs.

Each candidate group gets the shingle sets of its classes once and all of its pairs are decided exactly. Around a
pivot the triangle inequality of the Jaccard distance saves work: members within half the allowed distance of
it are linked to one another. Large groups are cut into blocks, so that each task holds two blocks' sets.

Words are as in `lm`; a document of fewer words than a shingle has one shingle of all of them. Defined cases: a null
text or one without words has no shingles and links with nothing; rows that repeat a doc_id or have none are documents of
their own, and a class of rows without an id has none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import bounded, components, merge_labels, mix, reused, runs_of, spread_hot
from trailforge.llm.lm import gram_hashes, word_hashes
from trailforge.session import checkpoint

TREES, DEEPEST = 24, 7
HOT_NODE = 20_000
#: Shingles in one block of a candidate group.
BLOCK_SHINGLES = 1_000_000


def prefix_length(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of this similarity shares one in some tree with at least this probability."""
    for k in range(deepest, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words, sizes = word_hashes(texts)
    own, valid = gram_hashes(words, sizes, size)[-1]
    out, at = [], 0
    for n in sizes.tolist():
        if n >= size:
            out.append(np.unique(own[at : at + n][valid[at : at + n]]))
        elif n:
            short = words[at : at + n]
            out.append(np.array([xxhash.xxh3_64_intdigest(short.tobytes(), n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class MinHash:
    """TREES * DEEPEST minimum hashes of sets, in passes over chunks that stay in cache."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 31, TREES * DEEPEST, np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, TREES * DEEPEST, np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        out, at = np.empty((len(sets), len(self.a)), np.uint32), 0
        while at < len(sets):
            to, n = at, 0
            while to < len(sets) and (n < 200_000 or to == at):
                n += len(sets[to])
                to += 1
            x = (mix(np.concatenate(sets[at:to])) >> np.uint64(32)).astype(np.uint32)
            first = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
            for k in range(len(self.a)):
                out[at:to, k] = np.minimum.reduceat(x * self.a[k] + self.b[k], first)
            at = to
        return out


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 3) words of one bit for each minimum hash."""
    bits = ((values * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 192 - bits.shape[1]))), 1)
    return np.ascontiguousarray(packed).view("<u8")


def _apart(similarity: float) -> int:
    """More differing bits than this put a pair five deviations below the similarity."""
    n, p = TREES * DEEPEST, (1 - similarity) / 2
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.uint16)


def node_groups(bits: np.ndarray, tails: np.ndarray, side: np.ndarray | None, apart: int) -> np.ndarray:
    """Labels of the classes under one node that sketches let through: each row's least connected row.

    side: None, or which of two blocks a row belongs to when only pairs across them count. Longer prefixes (columns
    of tails) come first; at the node itself every pair not yet in one group is compared.
    """
    n = len(bits)
    labels = np.arange(n)
    if side is None and n > 64:
        for depth in range(tails.shape[1], -1, -1):  # along each run of equal prefixes, all rows against the first
            order, first, size = runs_of(*(tails[:, k] for k in range(depth))) if depth else (np.arange(n), np.zeros(1, np.int64), np.array([n]))
            lead = np.repeat(order[first], size)
            near = np.bitwise_count(bits[order] ^ bits[lead]).sum(1) <= apart
            labels = merge_labels(labels, order[near], lead[near])
        largest = np.bincount(labels).argmax()
        rows = np.flatnonzero(labels != largest)
        cols = np.arange(n)
    elif side is None:
        rows = cols = np.arange(n)
    else:
        rows, cols = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    for at in range(0, len(rows), 512):
        a = rows[at : at + 512]
        for to in range(0, len(cols), 8192):
            b = cols[to : to + 8192]
            i, j = np.nonzero((_distance(bits[a], bits[b]) <= apart) & (labels[a][:, None] != labels[b][None, :]))
            if len(i):
                labels = merge_labels(labels, a[i], b[j])
    return labels


def jaccard_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, by weight, and labels) over all pairs, or all pairs across two sides, decided exactly."""
    n = len(sets)
    count, labels = np.zeros(n, np.int64), np.arange(n)
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1, np.int32)

    def similarity(k: int) -> np.ndarray:
        own = flat[first[k] : first[k] + sizes[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], first)
        mark[own] = 0
        return both / (sizes + sizes[k] - both)

    left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    done = np.zeros(n, bool)
    if n > 16:  # pairs within half the allowed distance of a pivot are linked
        near = 1 - similarity(int(left[0])) <= (1 - threshold) / 2 - 1e-9
        a, b = left[near[left]], right[near[right]]
        if len(a) and len(b):
            if side is None:
                count[a] += weight[a].sum() - weight[a]
            else:
                count[a] += weight[b].sum()
                count[b] += weight[a].sum()
            labels = merge_labels(labels, np.r_[a, b], np.full(len(a) + len(b), a[0]))
        done = near
    for k in left.tolist():
        if side is None:
            if done[k]:
                continue
            other = np.arange(n)[(np.arange(n) > k) | done]  # with each later row, and with all rows near the pivot
        else:
            other = right[~done[right]] if done[k] else right
            if not len(other):
                continue
        linked = other[similarity(k)[other] >= threshold]
        linked = linked[linked != k]
        if len(linked):
            count[k] += weight[linked].sum()
            count[linked] += weight[k]
            labels = merge_labels(labels, np.full(len(linked), k), linked)
    return count, labels


def jaccard_join(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, text_digest, n_links, class_id): one row per document; class_id is the least doc_id reachable by links.

    text_digest tells rows that share a doc_id apart: it is a hash of the shingle set.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    least = prefix_length(threshold, recall)
    apart = _apart(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                sets = shingles([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], size)
                full = [k for k, s in enumerate(sets) if len(s)]
                values = minhash([sets[k] for k in full]).reshape(len(full), TREES, DEEPEST)
                keys = np.zeros((len(full), TREES), np.uint64) + np.arange(TREES, dtype=np.uint64)[None, :]
                for depth in range(least):
                    keys = mix(keys) ^ values[:, :, depth].astype(np.uint64)
                keys = mix(keys)
                bits = _bits(values.reshape(len(full), -1))
                tails = (values[:, :, least:] & np.uint32(0xFFFF)).astype("<u2")
                digest, sig = [None] * len(sets), [None] * len(sets)
                for r, k in enumerate(full):
                    digest[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
                    sig[k] = bits[r].tobytes() + keys[r].astype("<u8").tobytes() + tails[r].tobytes()
                yield pa.record_batch([part.column(0), part.column(2), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "hash", "digest", "n_sh", "sig"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.ascontiguousarray(raw[:, :24]).view("<i8")
            keys = np.ascontiguousarray(raw[:, 24 : 24 + 8 * TREES]).view("<i8")
            tails = np.ascontiguousarray(raw[:, 24 + 8 * TREES :]).view("<u2").reshape(batch.num_rows, TREES, -1)
            for t in range(TREES):
                tail = np.zeros(batch.num_rows, np.int64)
                for k in range(tails.shape[2]):
                    tail = tail << 16 | tails[:, t, k]
                yield pa.record_batch([pa.array(np.ascontiguousarray(keys[:, t])), batch.column("node"), pa.array(tail), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(3))], names=["key", "node", "tail", "b0", "b1", "b2"])

    levels = DEEPEST - least

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        col = {c: table.column(c).to_numpy() for c in ("key", "bi", "bj", "blk", "node", "tail")}
        bits = np.stack([table.column(f"b{k}").to_numpy() for k in range(3)], 1).view(np.uint64)
        order, first, many = runs_of(col["key"], col["bi"], col["bj"])
        a, b = [], []
        two = first[many == 2]  # most nodes that have company have one pair
        i, j = order[two], order[two + 1]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= apart
        a.append(col["node"][i[near]]), b.append(col["node"][j[near]])
        for k in np.flatnonzero(many > 2).tolist():
            at = order[first[k] : first[k] + many[k]]
            tails = np.stack([(col["tail"][at] >> (16 * (levels - 1 - d))) & 0xFFFF for d in range(levels)], 1) if levels else np.zeros((len(at), 0), np.int64)
            across = col["bi"][at[0]] != col["bj"][at[0]]
            labels = node_groups(bits[at], tails, col["blk"][at] if across else None, apart)
            moved = np.flatnonzero(labels != np.arange(len(at)))
            a.append(col["node"][at[moved]]), b.append(col["node"][at[labels[moved]]])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                sets = shingles([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], size)
                same = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays([c for c in part.filter(pa.array(same)).columns], names=["digest", "node", "n", "comp", "nb", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        col = {c: table.column(c).to_numpy() for c in ("comp", "bi", "bj", "blk", "node", "n")}
        data = table.column("shingles")
        order, first, many = runs_of(col["comp"], col["bi"], col["bj"])
        nodes, links, roots = [], [], []
        for k in range(len(first)):
            at = order[first[k] : first[k] + many[k]]
            at = at[np.unique(col["node"][at], return_index=True)[1]]  # rows that repeat a document
            if len(at) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in data.take(pa.array(at)).to_pylist()]
            across = col["bi"][at[0]] != col["bj"][at[0]]
            if across and len(set(col["blk"][at].tolist())) < 2:
                continue
            count, labels = jaccard_links(sets, col["n"][at], col["blk"][at] if across else None, threshold)
            some = np.flatnonzero(count)
            nodes.append(col["node"][at[some]]), links.append(count[some]), roots.append(col["node"][at[labels[some]]])
        if nodes:
            yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links)), pa.array(np.concatenate(roots))], names=["node", "links", "root"])

    rows = reused(typed.mapInArrow(sign, "doc_id long, hash long, digest binary, n_sh long, sig binary"))
    node = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"), F.count("*").alias("n"), F.first("n_sh").alias("n_sh"), F.first("sig").alias("sig")).withColumn("node", node)
    classes = checkpoint(classes)  # cut here and below: plans that hold one another's plans cost the driver's memory
    spread = spread_hot(classes.select("node", "sig").mapInArrow(explode, "key long, node long, tail long, b0 long, b1 long, b2 long"), "key", "node", HOT_NODE)
    near = spread.repartition("key", "bi", "bj").mapInArrow(gather, "a long, b long")
    groups = components(near)
    member = classes.select("digest", "node", "first", "n", "n_sh").join(groups, "node").withColumnRenamed("component", "comp")
    cuts = groups.join(classes.select("node", "n_sh"), "node").groupBy("component").agg(F.ceil(F.sum("n_sh") / BLOCK_SHINGLES).cast("int").alias("nb")).withColumnRenamed("component", "comp")
    member = member.join(cuts, "comp")
    # one row of each class by its id and its text's hash, so that rows without an id or with the same one meet their own class only
    wanted = bounded(checkpoint(member.select(F.col("first.doc_id").alias("rep"), F.col("first.hash").alias("rep_hash"), "digest", "node", "n", "comp", "nb")))
    sets = typed.join(wanted, (typed["hash"] == F.col("rep_hash")) & typed["doc_id"].eqNullSafe(F.col("rep"))).select("digest", "node", "n", "comp", "nb", "text").mapInArrow(collect, "digest binary, node long, n long, comp long, nb int, shingles binary")
    blk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int")
    dealt = sets.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("comp", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "node", "n", "shingles")
    found = checkpoint(dealt.repartition("comp", "bi", "bj").mapInArrow(verify, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("digest", "node", "rep", "n").join(links, "node", "left").join(linked, "node", "left")
    named = checkpoint(named.select("digest", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")))
    told = named.join(named.groupBy("c").agg(F.min("rep").alias("class_id")), "c").select("digest", "n_links", "class_id")
    out = rows.select("doc_id", "digest").join(told, "digest", "left")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_digest"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))
