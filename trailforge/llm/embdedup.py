"""Near-duplicate embeddings by cross-polytope hashing.

A vector is filled up to a power of two and rotated by three rounds of random signs and a fast Hadamard transform; the
nearest corner of the cross-polytope (the coordinate of largest size, with its sign) is one hash. A few hashes make a
bucket of one table. Multiprobe: a vector also stands in the buckets that it would reach by its second-best corner
in one of the hashes. How many hashes and tables there are follows from the threshold and the vectors' length: drawn
pairs of that cosine tell how often two share a bucket of one table (`plan_tables`), and there are as many tables as
miss at most MISSED of such pairs. Buckets are dealt by ids alone; only those with company get their vectors. Pairs that
share a bucket are verified by their cosine in double precision, in blocks of a matrix product, and are neither kept nor
sent: only how many links each vector has, and a spanning forest of them. A pair that meets more than once counts only in
the first bucket that both stand in.

Equal vectors of one label are one class and are looked at once. A bucket of more than `hot` classes is cut into
blocks whose pairs meet in tasks of their own, so that no task holds more than two blocks.

Defined cases: a vector that is null, zero, or holds null or non-finite components, or whose label or id is null, links
with nothing; vectors of different lengths link with nothing; rows that repeat a vec_id are vectors of their own, and
equal rows link with one another; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import components, merge_labels, mix, reused, runs_of, spread_hot

#: Share of pairs at the threshold that may share no bucket, and the most tables that hashes are kept for.
MISSED, MOST_TABLES = 1e-5, 12
HOT_BUCKET = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = 11) -> np.ndarray:
    """(n, tables, hashes + 1) bucket codes of unit vectors, the vector's own bucket first."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    full = np.zeros((n, size))
    full[:, :d] = x
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, hashes + 1), np.int64)
    for t in range(tables):
        corners = []
        for _ in range(hashes):
            y = full
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            best = np.argpartition(-np.abs(y), 1, 1)[:, :2]
            own = np.take_along_axis(y, best, 1)
            swap = np.abs(own[:, 1]) > np.abs(own[:, 0])
            best[swap], own[swap] = best[swap][:, ::-1], own[swap][:, ::-1]
            corners.append(2 * best + (own < 0))
        scale = (2 * size) ** np.arange(hashes)
        own = sum(c[:, 0] * m for c, m in zip(corners, scale, strict=True))
        out[:, t, 0] = own
        for k, (c, m) in enumerate(zip(corners, scale, strict=True), 1):
            out[:, t, k] = own + (c[:, 1] - c[:, 0]) * m
    return out


def plan_tables(threshold: float, dims: int, missed: float = MISSED) -> tuple[int, int]:
    """(hashes, tables) for vectors of up to dims numbers: three hashes a table if MOST_TABLES tables then miss at most this share of the
    pairs at the threshold, as drawn pairs show, else two, else one with as many tables as it takes."""
    rng, pairs = np.random.default_rng(17), max(200, min(2000, 500_000 // dims))
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    a = unit(rng.normal(size=(pairs, dims)))
    other = rng.normal(size=(pairs, dims))
    b = unit(other - (other * a).sum(1, keepdims=True) * a) if dims > 1 else a
    cosine = min(1.0, max(-1.0, threshold))
    b = cosine * a + np.sqrt(1 - cosine * cosine) * b
    for hashes in (3, 2, 1):
        own, near = codes(a, 2, hashes, 29), codes(b, 2, hashes, 29)
        met = (own[:, :, :, None] == near[:, :, None, :]).any((2, 3)).mean()
        share = min(max(float(met) - 2 * np.sqrt(met * (1 - met) / (2 * pairs)), 1e-3), 1 - 1e-6)  # two deviations on the safe side
        tables = int(np.ceil(np.log(missed) / np.log(1 - share)))
        if tables <= MOST_TABLES or hashes == 1:
            return hashes, max(2, tables)
    raise AssertionError


def _vectors(data: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)


class _Links:
    """Links found in one task: how many each row has, by weight, and labels of what they connect.

    t and code say in which bucket a row stands, own_codes (n, tables, probes) all buckets of its vector.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, own_codes: np.ndarray, t: np.ndarray, code: np.ndarray, threshold: float):
        self.x, self.weight, self.codes, self.t, self.code, self.threshold = x, weight, own_codes, t, code, threshold
        self.norm = np.sqrt((x * x).sum(1))
        self.count, self.labels = np.zeros(len(x), np.int64), np.arange(len(x))

    def small(self, groups: np.ndarray) -> None:
        """All pairs in each of many groups of one size; groups (g, size) of rows."""
        size = groups.shape[1]
        each = max(1, 2_000_000 // (size * max(size, self.x.shape[1])))
        for at in range(0, len(groups), each):
            g = groups[at : at + each]
            x, n = self.x[g], self.norm[g]
            near = np.matmul(x, x.transpose(0, 2, 1)) / (n[:, :, None] * n[:, None, :]) >= self.threshold
            k, i, j = np.nonzero(near & np.triu(np.ones((size, size), bool), 1))
            self.found(g[k, i], g[k, j])

    def cross(self, rows: np.ndarray, cols: np.ndarray, triangle: bool) -> None:
        """All pairs of rows and cols (of rows, each once, if triangle)."""
        for at in range(0, len(rows), 1024):
            a = rows[at : at + 1024]
            for to in range(at if triangle else 0, len(cols), 1024):
                b = cols[to : to + 1024]
                near = (self.x[a] @ self.x[b].T) / (self.norm[a][:, None] * self.norm[b][None, :]) >= self.threshold
                if triangle and to == at:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                self.found(a[i], b[j])

    def found(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count linked pairs of one bucket each, but for those that share an earlier bucket."""
        for at in range(0, len(i), 1 << 18):
            self._found(i[at : at + (1 << 18)], j[at : at + (1 << 18)])

    def _found(self, i: np.ndarray, j: np.ndarray) -> None:
        t, code, before = self.t[i], self.code[i], np.zeros(len(i), bool)
        _, tables, probes = self.codes.shape
        for table in range(tables):
            earlier, here = table < t, table == t
            for p in range(probes):
                own = self.codes[i, table, p]
                useful = earlier | (here & (own < code))
                for q in range(probes):
                    before |= useful & (own == self.codes[j, table, q])
        i, j = i[~before], j[~before]
        if len(i):
            self.count += np.bincount(i, self.weight[j], len(self.count)).astype(np.int64) + np.bincount(j, self.weight[i], len(self.count)).astype(np.int64)
            self.labels = merge_labels(self.labels, i, j)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, hot: int = HOT_BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data, nodes, dims = [], [], [], []
            for i, v, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and i is not None and label is not None and not v.values.null_count else None
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    digests.append(None), data.append(None), nodes.append(None), dims.append(None)
                    continue
                raw = x.tobytes()
                whole = xxhash.xxh3_128_digest(raw + b"|" + label.encode())
                digests.append(whole), data.append(raw), nodes.append(int.from_bytes(whole[:8], "little", signed=True)), dims.append(len(x))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "label", "digest", "node", "v", "dim"])

    rows = reused(typed.mapInArrow(read, "vec_id long, label string, digest binary, node long, v binary, dim int"))
    hashes, tables = plan_tables(threshold, rows.agg(F.max("dim").alias("d")).first()["d"] or 1)
    classes = rows.where("digest IS NOT NULL").groupBy("digest", "node", "label", "v", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = _vectors(part.column("v").to_pylist(), kind)
                own = codes(x / np.sqrt((x * x).sum(1, keepdims=True)), tables, hashes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in own.astype("<i8").reshape(len(x), -1)], pa.binary())], names=[*part.schema.names, "codes"])

    classes = reused(classes.select("digest", "node", "label", "v", "dim", "rep", "n").mapInArrow(code, "digest binary, node long, label string, v binary, dim int, rep long, n long, codes binary"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i8").reshape(batch.num_rows, tables, hashes + 1)
            salt = np.array([xxhash.xxh3_64_intdigest(f"{label}|{d}") for label, d in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)], np.uint64)
            for t in range(tables):
                for p in range(hashes + 1):
                    key = mix(mix(own[:, t, p].astype(np.uint64) + np.uint64(t << 40)) ^ salt)
                    yield pa.record_batch([pa.array(key.view(np.int64)), batch.column("node"), batch.column("digest"), pa.array(np.full(len(key), t, np.int32)), pa.array(np.ascontiguousarray(own[:, t, p]))], names=["key", "node", "digest", "t", "code"])

    dealt = reused(classes.select("node", "digest", "label", "dim", "codes").mapInArrow(deal, "key long, node long, digest binary, t int, code long"))
    company = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    spread = spread_hot(reused(dealt.join(company, "key", "left_semi")), "key", "node", hot).join(classes.select("digest", "n", "v", "codes"), "digest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        col = {c: table.column(c).to_numpy() for c in ("key", "bi", "bj", "blk", "node", "n", "t", "code")}
        order, first, size = runs_of(col["key"], col["bi"], col["bj"])
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return
        rows, size = order[keep], size[size > 1]  # only rows that have company
        first = np.cumsum(size) - size
        table, col = table.take(pa.array(rows)), {c: v[rows] for c, v in col.items()}
        lengths = np.array([len(x) for x in table.column("v").to_pylist()])
        for width in np.unique(lengths).tolist():  # vectors of one length at a time; a bucket holds one length
            mine = np.flatnonzero(lengths == width)
            whole_groups = lengths[first] == width
            place = np.full(len(lengths), -1)
            place[mine] = np.arange(len(mine))
            part = table.take(pa.array(mine))
            own = np.frombuffer(b"".join(part.column("codes").to_pylist()), "<i8").reshape(len(mine), tables, hashes + 1)
            task = _Links(_vectors(part.column("v").to_pylist(), kind), col["n"][mine], own, col["t"][mine], col["code"][mine], threshold)
            starts, sizes = place[first[whole_groups]], size[whole_groups]
            across = (col["bi"] != col["bj"])[first[whole_groups]]
            for n in np.unique(sizes[(sizes <= 64) & ~across]).tolist():
                task.small(starts[(sizes == n) & ~across][:, None] + np.arange(n)[None, :])
            for at, n, cut in zip(starts.tolist(), sizes.tolist(), across.tolist(), strict=True):
                group = np.arange(at, at + n)
                if cut:
                    blk, bi = col["blk"][mine[group]], col["bi"][mine[at]]
                    task.cross(group[blk == bi], group[blk != bi], False)
                elif n > 64:
                    task.cross(group, group, True)
            some = np.flatnonzero(task.count)
            node = col["node"][mine]
            if len(some):
                yield pa.record_batch([pa.array(node[some]), pa.array(task.count[some]), pa.array(node[task.labels[some]])], names=["node", "links", "root"])

    found = reused(spread.repartition("key", "bi", "bj").mapInArrow(verify, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "digest", "rep", "n").join(links, "node", "left").join(joined, "node", "left")
    named = reused(named.select("digest", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    told = named.join(least, "c").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(told, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
