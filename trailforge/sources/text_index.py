"""An inverted index of texts in blocks with bounds of score, and BM25 from it with an early stop.

    blocks   (token, range, ub, doc_ids, tfs, dls), sorted by token and range: the postings of a token within a range of
             RANGE_DOCS documents, and the highest saturated frequency among them
    tokens   (token, df), sorted by token
    stats    one row (n, avgdl, k1, b, blocks)

Documents lie in ranges as they lie in the input, so blocks are made where texts are read, and no document's text is
shuffled. A search adds up, for each query and range, what the bounds allow at most; that reads three narrow columns. The
ranges that promise most are scored whole, which gives a score that the k-th result has at least; of the other ranges only
those whose bound reaches it are read. No document is lost by that, and the result is that of scoring them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from trailforge.operators.retrieval import bounded, top_k

#: Documents of a range, and ranges that are scored first for each query, for each of its k results.
RANGE_DOCS, FIRST_RANGES = 8, 2
#: Bounds are compared with this slack, so that rounding loses nothing.
SLACK = 1e-8


def saturated(tf: Column, dl: Column, avgdl: float | Column, k1: float | Column, b: float | Column) -> Column:
    """The part of a BM25 weight that depends on the document."""
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def write(docs: DataFrame, tokens: Column, path: str, k1: float = 1.5, b: float = 0.75) -> TextIndex:
        """Index docs (doc_id, ...) under their tokens."""
        spark = docs.sparkSession
        split = docs.select("doc_id", tokens.alias("tokens")).withColumn("range", F.floor(F.monotonically_increasing_id() / RANGE_DOCS))
        # a document also sends a posting without a token, which carries its length
        spread = split.select("range", "doc_id", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
        one = spread.groupBy("token", "range", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl")).persist(StorageLevel.DISK_ONLY)
        stats = one.where("token = ''").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        n, avgdl = stats["n"], (stats["total"] or 0) / max(1, stats["n"])
        weight = saturated(F.col("tf"), F.col("dl"), avgdl or 1.0, k1, b)
        posting = F.struct("doc_id", "tf", "dl")
        blocks = one.where("token <> ''").groupBy("token", "range").agg(F.max(weight).alias("ub"), F.sort_array(F.collect_list(posting)).alias("p"))  # RANGE_DOCS postings at most
        blocks = blocks.select("token", "range", "ub", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
        blocks.repartitionByRange("token", "range").sortWithinPartitions("token", "range").write.mode("overwrite").parquet(f"{path}/blocks")
        stored = spark.read.parquet(f"{path}/blocks")
        stored.groupBy("token").agg(F.sum(F.size("doc_ids")).alias("df")).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/tokens")
        spark.createDataFrame([(n, float(avgdl), float(k1), float(b), stored.count())], "n long, avgdl double, k1 double, b double, blocks long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        one.unpersist()
        return TextIndex(spark, path)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def stats(self) -> dict:
        return self.spark.read.parquet(f"{self.path}/stats").first().asDict()

    def terms(self, asked: DataFrame) -> DataFrame:
        """(qid, token, weight) of the asked tokens (qid, token, qtf) that the index has."""
        n = self.stats()["n"]
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return self.spark.read.parquet(f"{self.path}/tokens").join(bounded(asked), "token").select("qid", "token", (F.col("qtf") * idf).alias("weight"))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(qid, range, bound): what a document of a range can have at most."""
        return self.blocks().select("token", "range", "ub").join(bounded(terms), "token").groupBy("qid", "range").agg(F.sum(F.col("weight") * F.col("ub")).alias("bound"))

    def read(self, terms: DataFrame, ranges: DataFrame) -> DataFrame:
        """The blocks of the terms in the ranges (qid, range) of their queries."""
        return self.blocks().join(bounded(terms), "token").join(bounded(ranges.select("qid", "range")), ["qid", "range"], "left_semi")

    def score(self, terms: DataFrame, ranges: DataFrame) -> DataFrame:
        """(qid, doc_id, score) of all documents with a term in these ranges; every term of theirs lies in the same range."""
        s = self.stats()
        each = self.read(terms, ranges).select("qid", "weight", F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p"))
        weight = F.col("weight") * saturated(F.col("p.tfs"), F.col("p.dls"), s["avgdl"], s["k1"], s["b"])
        return each.groupBy("qid", F.col("p.doc_ids").alias("doc_id")).agg(F.sum(weight).alias("score"))

    def rounds(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(first ranges, their scores, the ranges that can still reach the k-th score)."""
        bounds = self.bounds(terms).persist(StorageLevel.DISK_ONLY)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "range"))
        first = bounds.withColumn("place", place).where(F.col("place") <= FIRST_RANGES * k).select("qid", "range").persist(StorageLevel.DISK_ONLY)
        scores = self.score(terms, first).persist(StorageLevel.DISK_ONLY)
        least = top_k(scores, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        rest = bounds.join(bounded(least), "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        return first, scores, rest.join(first, ["qid", "range"], "left_anti").select("qid", "range").persist(StorageLevel.DISK_ONLY)

    def search(self, asked: DataFrame, k: int = 10) -> DataFrame:
        """Ranked (qid, rank, doc_id, score) of asked tokens (qid, token, qtf): the same as scoring every document."""
        terms = self.terms(asked).persist(StorageLevel.DISK_ONLY)
        _, scores, rest = self.rounds(terms, k)
        return top_k(scores.union(self.score(terms, rest)), k)


#: Characters of the pieces that are looked up for a pattern, documents that one mask stands for, ranges of them whose texts lie in
#: one folder, folders that hold texts, pieces of a pattern that are looked up, the rarest ones, and characters of several
#: documents that are cut at a time: as many different ones fit LETTER_BITS.
GRAM, GRAM_RANGE, FOLDER_RANGES, TEXT_FOLDERS, GRAMS_ASKED, LETTER_BITS, CHARACTERS = 3, 64, 16, 256, 8, 19, 1 << 19


def numbered(points: np.ndarray) -> np.ndarray:
    """The pieces of three code points at each place, as numbers."""
    points = points.astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def grams(text: str) -> list[int]:
    """The distinct pieces of a pattern."""
    return sorted(set(numbered(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist()))


def _masks(texts: list[str], sizes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of some texts of one range, CHARACTERS in all unless it is one text, and the mask of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(texts) == 1:
        pieces = np.unique(numbered(points))
        return pieces, np.full(len(pieces), bits[0])
    if len(points) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters, rank = np.flatnonzero(seen), np.cumsum(seen) - 1
    codes, place = rank[points], np.repeat(np.arange(len(texts)), sizes)
    codes = ((codes[:-2] << LETTER_BITS | codes[1:-1]) << LETTER_BITS | codes[2:]) << 6 | place[2:]  # a range has 64 documents at most
    codes = np.sort(codes[place[:-2] == place[2:]])
    if not len(codes):
        return codes, codes
    triples = codes >> 6
    starts = np.flatnonzero(np.concatenate([[True], triples[1:] != triples[:-1]]))
    docs, triples, low = np.bitwise_or.reduceat(bits[codes & 63], starts), triples[starts], (1 << LETTER_BITS) - 1
    return letters[triples >> 2 * LETTER_BITS] << 42 | letters[triples >> LETTER_BITS & low] << 21 | letters[triples & low], docs


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, range, docs) of texts (range, bit, text): a mask of the documents of a range that have a piece. A range whose documents
    do not lie together has several masks of a piece, with other documents in each."""
    for batch in batches:
        ranges, bits, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = 0
        while begin < len(texts):
            end, room = begin + 1, CHARACTERS - sizes[begin]
            while end < len(texts) and ranges[end] == ranges[begin] and sizes[end] <= room:
                room, end = room - sizes[end], end + 1
            pieces, docs = _masks(texts[begin:end], sizes[begin:end], bits[begin:end])
            yield pa.record_batch([pa.array(pieces), pa.array(np.full(len(pieces), ranges[begin])), pa.array(docs)], names=["gram", "range", "docs"])
            begin = end


@dataclass
class GramIndex:
    """Lower-cased texts by their pieces of three characters: a pattern is looked for only where all of its pieces stand.

    texts    (doc_id, text, range, bit, folder): the texts, in folders by range, with the bit that each has in its range's masks
    grams    (gram, range, docs), sorted by gram: masks of the documents of a range that have a piece

    Masks are made where texts are read, from the stored texts, so a document sends no row for each of its pieces.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def write(docs: DataFrame, path: str) -> GramIndex:
        """Index docs (doc_id, text)."""
        spark = docs.sparkSession
        own = docs.where(F.col("text").isNotNull()).select("doc_id", "text").withColumn("k", F.monotonically_increasing_id()).withColumn("range", F.floor(F.col("k") / GRAM_RANGE))
        own = own.withColumn("bit", F.expr(f"shiftleft(1L, cast(k % {GRAM_RANGE} as int))")).withColumn("folder", F.pmod(F.floor(F.col("range") / FOLDER_RANGES), F.lit(TEXT_FOLDERS)).cast("int")).drop("k")
        own.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/texts")
        own.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
        index = GramIndex(spark, path)
        found = index.texts().select("range", "bit", F.lower("text").alias("text")).mapInArrow(masks, "gram long, range long, docs long")
        found.repartition("gram").sortWithinPartitions("gram", "range").write.mode("overwrite").parquet(f"{path}/grams")
        return index

    def texts(self) -> DataFrame:
        """(doc_id, text, range, bit, folder) of all documents."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/texts")

    def _found(self, pattern: str) -> DataFrame | None:
        """The texts that have the rarest pieces of a pattern; only the folders that hold some are read. None where it has no pieces."""
        pieces = grams(pattern.lower())
        if not pieces:
            return None
        stored = self.spark.read.parquet(f"{self.path}/grams")
        sizes = stored.where(F.col("gram").isin(pieces)).groupBy("gram").agg(F.sum(F.bit_count("docs")).alias("df")).orderBy("df", "gram").limit(GRAMS_ASKED).collect()
        known = sizes if len(sizes) == min(len(pieces), GRAMS_ASKED) else []  # a piece that no text has
        rarest = [r["gram"] for r in known]
        each = stored.where(F.col("gram").isin(rarest)).groupBy("range", "gram").agg(F.bit_or("docs").alias("docs"))
        found = each.groupBy("range").agg(F.count("*").alias("n"), F.bit_and("docs").alias("docs")).where((F.col("n") == len(rarest)) & (F.col("docs") != 0)).select("range", "docs").persist(StorageLevel.DISK_ONLY)
        folder = F.pmod(F.floor(F.col("range") / FOLDER_RANGES), F.lit(TEXT_FOLDERS)).cast("int")
        folders = [r["folder"] for r in found.select(folder.alias("folder")).distinct().collect()]  # TEXT_FOLDERS at most
        return self.texts().where(F.col("folder").isin(folders)).join(bounded(found), "range").where(F.col("docs").bitwiseAND(F.col("bit")) != 0)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(doc_id, folder) of documents that have the rarest pieces of a pattern; None where the pattern has none."""
        found = self._found(pattern)
        return None if found is None else found.select("doc_id", "folder")

    def matching(self, pattern: str) -> DataFrame:
        """(doc_id, text) of the documents in which the pattern may stand; only the folders that have some are read."""
        found = self._found(pattern)
        return (self.texts() if found is None else found).select("doc_id", "text")
