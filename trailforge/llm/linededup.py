"""Line dedup over levelled sorted runs of line hashes.

A run is a sorted array of 128-bit line hashes with a count each. New batches become small runs at level 0; when a
level holds `fanout` runs they are merged into one run of the next level, so each hash is rewritten a logarithmic
number of times. A batch is held against the runs by merge (binary search in sorted arrays): what the runs lack is
new, and the batch is then added as a run of its own.

Hashes are dealt to tasks by value; each map task sums its own lines first, so a line that stands in a third of all
documents reaches its task once per map task. What becomes frequent is told by the merge: a line goes out when a batch
lifts its count over the bound. `LineRuns` keeps the same levels as sorted Parquet, so that later batches of documents
are held against earlier ones; a run is found by the batches it covers, so a merge that is cut off loses nothing.

Defined cases: a null or empty text is one empty line; empty keys are always kept; rows that repeat a doc_id count as
documents of their own, as do rows without one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.llm.common import checkpoint

#: What is stripped from both ends of a line.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Distinct lines that a map task sums up before it sends them on.
LINES_HELD = 500_000


class SortedRuns:
    """Counts of fixed-width keys in levelled sorted runs."""

    def __init__(self, width: int = 17, fanout: int = 4):
        self.kind, self.fanout = f"S{width}", fanout
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []

    @staticmethod
    def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key over all runs, 0 where none has it."""
        total = np.zeros(len(keys), np.int64)
        for level in self.levels:
            for run, counts in level:
                if len(run):
                    at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
                    total += np.where(run[at] == keys, counts[at], 0)
        return total

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add a batch; returns its sorted distinct keys, their counts in it, and the counts that all runs had of them before, 0 for
        those that no run had (the merge anti-join)."""
        run = self._merged([(np.asarray(keys, self.kind), np.asarray(counts, np.int64))])
        found = *run, self.lookup(run[0])
        k = 0
        while len(run[0]):
            if k == len(self.levels):
                self.levels.append([])
            self.levels[k].append(run)
            if len(self.levels[k]) < self.fanout:
                break
            run, self.levels[k] = self._merged(self.levels[k]), []
            k += 1
        return found

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else (np.zeros(0, self.kind), np.zeros(0, np.int64))


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(digest, n): in how many documents of a map task each line key of at least min_chars code points stands; not yet summed over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["digest", "n"])
            found.clear()
            return rows

        for batch in batches:
            for text in _as_bytes(batch.column(0)):
                if text:
                    found.update(map(digest, {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, min_chars)}))
                if len(found) > LINES_HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "digest binary, n long")


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Digests (column digest) of the line keys of at least min_chars code points that stand in at least min_docs documents."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = SortedRuns()
        for batch in batches:
            keys = np.array([k + b"\x01" for k in batch.column(0).to_pylist()], "S17")  # no key may end in a zero byte
            own, counts, before = runs.add(keys, batch.column(1).to_numpy())
            lifted = own[(before < min_docs) & (before + counts >= min_docs)]
            yield pa.record_batch([pa.array([k[:16] for k in lifted.tolist()], pa.binary())], names=["digest"])

    return line_counts(docs, min_chars).repartition("digest").mapInArrow(keep, "digest binary")


class LineRuns:
    """Levelled sorted runs of line digests (digest, n) as Parquet under a folder that all executors reach.

    Each added batch is a run of its own, named by its number; `fanout` runs of one size are merged into one that is named by the
    first and last batch it covers. A run that a larger one covers is no longer read, and is deleted after the merge.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int = 32):
        self.spark, self.path, self.fanout, self.buckets = spark, path.rstrip("/"), fanout, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self):
        return self._hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of each live run, in order."""
        fs, root = self._fs(), self._hadoop.Path(self.path)
        if not fs.exists(root):
            return []
        named = [re.fullmatch(r"run-(\d+)-(\d+)", f.getPath().getName()) for f in fs.listStatus(root) if fs.exists(self._hadoop.Path(f.getPath(), "_SUCCESS"))]
        found = [(int(m[1]), int(m[2])) for m in named if m]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _read(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("digest binary, n long").parquet(f"{self.path}/run-{run[0]}-{run[1]}")

    def _write(self, counts: DataFrame, run: tuple[int, int]) -> None:
        counts.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(f"{self.path}/run-{run[0]}-{run[1]}")

    def counts(self) -> DataFrame:
        """(digest, n) over all batches."""
        rows = self.spark.createDataFrame([], "digest binary, n long")
        for run in self.runs():
            rows = rows.union(self._read(run))
        return rows.groupBy("digest").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> DataFrame:
        """Add a batch (digest, n); returns (digest, n, before): what it holds and how much earlier batches had, 0 for new lines."""
        earlier = self.runs()
        number = 1 + max((last for _, last in earlier), default=-1)
        summed = counts.groupBy("digest").agg(F.sum("n").alias("n"))
        self._write(summed, (number, number))
        before = self.spark.createDataFrame([], "digest binary, n long")
        for run in earlier:
            before = before.union(self._read(run))
        met = self._read((number, number)).join(before.groupBy("digest").agg(F.sum("n").alias("before")), "digest", "left")
        met = checkpoint(met.select("digest", "n", F.coalesce("before", F.lit(0)).alias("before")))
        self._compact()
        return met

    def _compact(self) -> None:
        size = 1
        while True:
            level = [r for r in self.runs() if r[1] - r[0] + 1 == size]
            if len(level) < self.fanout:
                return
            merged = level[: self.fanout]
            rows = self._read(merged[0])
            for run in merged[1:]:
                rows = rows.union(self._read(run))
            self._write(rows.groupBy("digest").agg(F.sum("n").alias("n")), (merged[0][0], merged[-1][1]))
            for run in merged:
                self._fs().delete(self._hadoop.Path(f"{self.path}/run-{run[0]}-{run[1]}"), True)
            size *= self.fanout


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, carry: tuple[str, ...] = (), prefix: str = "", runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, *carry, text, n_lines, n_dropped, kept): each document without the lines that min_docs documents or more have.

    prefix: put before the three new names, for tables that have columns of these names. runs: what earlier batches had; docs
    are added to them, and their lines are judged by all documents so far.

    Lines meet the frequent digests in a join that Spark may split where one line is hot, and each document's dropped digests
    come back to it by a hash of its id and text; rows of one hash share what they lose, which only holds frequent lines.
    """
    row = F.xxhash64("doc_id", "text")
    lines = docs.select(row.alias("row"), "text").mapInArrow(_own_digests, "row long, digest binary")
    frequent = frequent_lines(docs, min_docs, min_chars) if runs is None else runs.add(line_counts(docs, min_chars)).where(F.col("n") + F.col("before") >= min_docs).select("digest")
    lost = lines.join(frequent, "digest").groupBy(F.col("row").alias("__row")).agg(F.collect_set("digest").alias("__lost"))
    text_of = docs.select(F.col("doc_id"), *carry, F.col("text"), row.alias("__row"))
    joined = text_of.join(lost, "__row", "left").select("doc_id", *carry, "text", "__lost")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry, "text"))
    new = [f"{prefix}{c}" for c in ("n_lines", "n_dropped", "kept")]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, lost in zip(_as_bytes(batch.column("text")), batch.column("__lost").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                if lost:
                    gone = set(lost)
                    stay = [x for x in lines if not (k := line_key(x)) or digest(k) not in gone]
                else:
                    stay = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay) if lost else text or b"")
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *carry, "text")), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", *carry, "text", *new])

    return joined.mapInArrow(drop, f"{kinds}, `{new[0]}` long, `{new[1]}` long, `{new[2]}` string")


def _own_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), _as_bytes(batch.column(1)), strict=True):
            own = {k for k in map(line_key, (text or b"").split(b"\n")) if k}
            ids.extend([doc] * len(own))
            found.extend(map(digest, own))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["row", "digest"])


def digest_columns(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
