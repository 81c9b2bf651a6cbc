"""A vector store: an inverted file of vectors by cell, asked by id and by vector.

    cells/__cell=7/... vectors of a cell with their other columns; a large cell has several files
    centroids           (cell, n, radius, shortest, longest, centroid): the direction of each cell, the widest angle of its
                        vectors to it, and their lengths
    schema              no rows; the columns of a store, which may be empty
    ids                 (doc_id, cell), sorted by doc_id
    probes              one row (probes, recall, k): how many cells a search reads, and what share of the true best k that finds

Cells are directions learned by k-means on a bounded sample; every vector goes to the cell of the nearest one. A search
ranks the cells of each query, takes as many as a trial with stored vectors has shown to be enough, and reads only the folders of cells that some query asks for: they are named in the
scan, so Spark prunes them when it plans. What is read is scored exactly, in double precision, and each batch hands on only
its best rows. With `exact`, a second round reads the cells that could still hold something better, which the triangle
inequality of angles tells from centroid and radius: the result is then that of a full scan.

Vectors that are null, zero or hold null or non-finite components are in cell -1: they can be had by id and are counted, but no
search finds them. Queries of that kind find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.operators.retrieval import bounded, top_k

#: Cells at most, vectors of the sample for each cell, rows of a file, and numbers of the query vectors that a pass holds.
MAX_CELLS, SAMPLE_PER_CELL, FILE_ROWS, QUERY_NUMBERS = 4096, 64, 200_000, 4_000_000
#: Stored vectors that are tried as queries, the results that are wanted of each, and the share of them that has to be found.
TRIED, TRIED_K, RECALL = 200, 10, 0.95
#: Cell of vectors that have no direction.
NOWHERE = -1
#: Scores are compared with this slack, so that rounding loses nothing.
SLACK = 1e-8


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, size) doubles, and which rows have a direction and this size."""
    out, good = np.zeros((len(column), size)), np.zeros(len(column), bool)
    for k, row in enumerate(column):
        values = row.values.to_numpy(zero_copy_only=False) if row.is_valid else ()
        if len(values) == size:
            own = values.astype(np.float64)
            if np.isfinite(own).all() and own.any():
                out[k], good[k] = own, True
    return out, good


@dataclass
class VectorStore:
    spark: SparkSession
    path: str

    @staticmethod
    def write(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 1) -> VectorStore:
        """Store (doc_id, vec, ...). The number of cells follows the square root of the number of vectors."""
        spark = vectors.sparkSession
        typed = vectors
        usable = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
        usable = F.coalesce(usable, F.lit(False))
        sizes = typed.where(usable).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
        n, size = sizes["n"], sizes["size"] or 0
        cells = min(n, cells or max(1, min(MAX_CELLS, round(n**0.5))))
        centroids = np.zeros((0, size))
        if cells:
            rate = min(1 << 20, (SAMPLE_PER_CELL * cells << 20) // n + 1)
            drawn = typed.where(usable & (F.size("vec") == size) & (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < rate))
            sample = drawn.select(array_to_vector("vec").alias("features")).persist(StorageLevel.DISK_ONLY)
            if not sample.isEmpty():
                model = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=10, seed=seed).fit(sample)
                centroids = np.array([c for c in model.clusterCenters() if np.any(c)])
                centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
            sample.unpersist()
        shared = spark.sparkContext.broadcast(centroids)  # MAX_CELLS at most
        others = [c for c in typed.columns if c not in ("doc_id", "vec")]
        names = ["doc_id", "vec", *others]
        kinds = ", ".join(f"`{c}` {typed.schema[c].dataType.simpleString()}" for c in names)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, good = _matrix(batch.column(1), size)
                cell, angle, length = np.full(len(own), NOWHERE, np.int32), np.zeros(len(own)), np.linalg.norm(own, axis=1)
                if good.any() and len(shared.value):
                    cosine = own[good] @ shared.value.T / length[good][:, None]
                    cell[good] = cosine.argmax(1)
                    angle[good] = np.arccos(np.clip(cosine.max(1), -1, 1))
                yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle), pa.array(length)], names=[*names, "__cell", "__angle", "__length"])

        placed = typed.select(*names).mapInArrow(place, f"{kinds}, __cell int, __angle double, __length double").persist(StorageLevel.DISK_ONLY)
        held = {r["cell"]: r for r in placed.groupBy(F.col("__cell").alias("cell")).agg(F.count("*").alias("n"), F.max("__angle").alias("radius"), F.min("__length").alias("shortest"), F.max("__length").alias("longest")).collect()}
        files = F.broadcast(spark.createDataFrame([(c, -(-r["n"] // FILE_ROWS)) for c, r in held.items()] or [(0, 1)], "__cell int, __files int"))
        dealt = placed.join(files, "__cell").withColumn("__file", F.pmod(F.xxhash64("doc_id"), F.col("__files"))).repartition("__cell", "__file")
        dealt.select(*names, "__cell").write.mode("overwrite").partitionBy("__cell").parquet(f"{path}/cells")
        placed.select("doc_id", F.col("__cell").alias("cell")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/ids")
        rows = [(c, r["n"], r["radius"], r["shortest"], r["longest"], centroids[c].tolist() if c >= 0 else None) for c, r in sorted(held.items())]
        typed.select(*names).limit(0).write.mode("overwrite").parquet(f"{path}/schema")
        spark.createDataFrame(rows, "cell int, n long, radius double, shortest double, longest double, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        placed.unpersist()
        store = VectorStore(spark, path)
        spark.createDataFrame([store._trial(n, seed)], "probes int, recall double, k int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
        return store

    def _trial(self, n: int, seed: int) -> tuple[int, float, int]:
        """The least number of cells that finds RECALL of the true neighbours of some stored vectors."""
        cells, _, centroids = self._centroids()
        if not len(cells):
            return 1, 1.0, TRIED_K
        rate = min(1 << 20, (TRIED << 20) // max(1, n) + 1)
        drawn = self.rows().where((F.col("__cell") >= 0) & (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 20)) < rate)).limit(2 * TRIED)
        queries = drawn.select(F.col("doc_id").cast("long").alias("qid"), "vec").dropDuplicates(["qid"]).persist(StorageLevel.DISK_ONLY)
        found = self.search(queries, TRIED_K, probes=len(cells))
        places = found.join(self.spark.read.parquet(f"{self.path}/ids").dropDuplicates(["doc_id"]), "doc_id").select("qid", "cell").collect()  # TRIED_K rows for each
        rows = queries.toArrow()
        vectors, _ = _matrix(rows.column("vec").combine_chunks(), centroids.shape[1])
        order = np.argsort(-vectors @ centroids.T, 1).argsort(1)
        place = {q: k for k, q in enumerate(rows.column("qid").to_pylist())}
        column = {int(c): j for j, c in enumerate(cells)}
        needed = np.sort([order[place[r["qid"]], column[r["cell"]]] for r in places if r["cell"] in column])
        if not len(needed):
            return len(cells), 1.0, TRIED_K
        probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1
        return probes, float((needed < probes).mean()), TRIED_K

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/probes").first()["probes"]

    def rows(self) -> DataFrame:
        """All stored rows with their cells (__cell)."""
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("__cell", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells")

    def count(self) -> int:
        """Stored vectors, told by the cells' sizes."""
        return self.spark.read.parquet(f"{self.path}/centroids").agg(F.sum("n").alias("n")).first()["n"] or 0

    def get(self, ids: DataFrame) -> DataFrame:
        """Rows of given ids (doc_id): the ids tell the cells, and only their folders are read."""
        known = self.spark.read.parquet(f"{self.path}/ids").join(bounded(ids.select("doc_id").distinct()), "doc_id", "left_semi").persist(StorageLevel.DISK_ONLY)
        cells = [r["cell"] for r in known.select("cell").distinct().collect()]  # MAX_CELLS at most
        return self.rows().where(F.col("__cell").isin(cells)).join(bounded(known.select("doc_id").distinct()), "doc_id", "left_semi").drop("__cell")

    def _centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, their (radius, shortest, longest), and their directions."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").where(F.col("cell") >= 0).orderBy("cell").collect()  # MAX_CELLS at most
        return np.array([r["cell"] for r in rows], np.int64), np.array([[r["radius"], r["shortest"], r["longest"]] for r in rows]).reshape(-1, 3).T, np.array([r["centroid"] for r in rows])

    def _scored(self, qids: list, vectors: np.ndarray, asked: np.ndarray, cells: np.ndarray, k: int, kind: str) -> DataFrame:
        """(qid, doc_id, score) of queries against the cells that `asked` (queries, cells) says: the best k of every batch of rows."""
        of_cell = {int(c): np.flatnonzero(asked[:, j]) for j, c in enumerate(cells) if asked[:, j].any()}
        shared = self.spark.sparkContext.broadcast((qids, vectors, of_cell))  # QUERY_NUMBERS at most
        arrow = pa.schema([("qid", pa.string() if kind == "string" else pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries, of = shared.value
            for batch in batches:
                own, _ = _matrix(batch.column(1), queries.shape[1])
                at = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(at).tolist():
                    rows = np.flatnonzero(at == c)
                    scores = queries[of[c]] @ own[rows].T
                    if len(rows) > k:  # ties of the k-th stay, and are broken by the ids of all batches
                        scores_kept = scores >= np.partition(scores, -k, 1)[:, -k][:, None] - SLACK
                    else:
                        scores_kept = np.ones(scores.shape, bool)
                    q, r = np.nonzero(scores_kept)
                    yield pa.record_batch([pa.array([names[x] for x in of[c][q]], arrow.field(0).type), batch.column(0).take(pa.array(rows[r])), pa.array(scores[q, r])], names=["qid", "doc_id", "score"])

        return self.rows().where(F.col("__cell").isin(sorted(of_cell))).select(F.col("doc_id").cast("long"), "vec", "__cell").mapInArrow(score, f"qid {kind}, doc_id long, score double")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """Ranked (qid, rank, doc_id, score) of queries (qid, vec), in passes of a bounded number of queries.

        probes: how many cells each query reads at first, as the trial said if not given. Scores are dot products with the query as a unit vector, so stored
        unit vectors have their cosine.
        """
        kind = queries.schema["qid"].dataType.simpleString()
        cells, (radius, shortest, longest), centroids = self._centroids()
        out = self.spark.createDataFrame([], f"qid {kind}, rank int, doc_id long, score double")
        if not len(cells):
            return out
        size, probes = centroids.shape[1], probes or self.probes()
        passes = max(1, -(-queries.count() * size // QUERY_NUMBERS))
        for number in range(passes):
            own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number) if passes > 1 else queries
            rows = own.select("qid", F.col("vec").cast("array<double>").alias("vec")).toArrow()
            vectors, good = _matrix(rows.column("vec").combine_chunks(), size)
            qids = [q for q, g in zip(rows.column("qid").to_pylist(), good, strict=True) if g]
            if not qids:
                continue
            norms = np.linalg.norm(vectors[good], axis=1, keepdims=True)
            unit = vectors[good] / (norms + 1e-8)
            angles = np.arccos(np.clip(vectors[good] / norms @ centroids.T, -1, 1))
            asked = np.zeros(angles.shape, bool)
            np.put_along_axis(asked, np.argsort(angles, 1)[:, : min(probes, len(cells))], True, 1)
            found = top_k(self._scored(qids, unit, asked, cells, k, kind), k)
            if exact:
                found = found.persist(StorageLevel.DISK_ONLY)
                worst = {r["qid"]: r["score"] for r in found.where(F.col("rank") == k).select("qid", "score").collect()}  # one row a query of the pass
                least = np.array([worst.get(q, -np.inf) for q in qids])
                best = np.cos(np.clip(angles - radius[None, :], 0, np.pi))
                best = np.where(best > 0, best * longest[None, :], best * shortest[None, :])
                more = ~asked & (best >= least[:, None] - SLACK)
                if more.any():
                    found = top_k(found.select("qid", "doc_id", "score").union(self._scored(qids, unit, more, cells, k, kind)), k)
            out = out.unionByName(found)
        return out
