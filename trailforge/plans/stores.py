"""Stores that are written once and asked often: vectors by cell, postings in blocks, texts by their pieces.

A store is built once for a session and table, in the shared folder, and read by every query that asks it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.functions import table_functions
from trailforge.functions.text import search_tokens
from trailforge.operators import retrieval as R
from trailforge.plans import retrieval
from trailforge.plans.registry import oracle_of, query
from trailforge.session import built, table
from trailforge.sources.text_index import GramIndex, TextIndex
from trailforge.sources.vector_store import VectorStore


def vectors(spark: SparkSession, sf: str) -> VectorStore:
    rows = table(spark, sf, "embeddings")
    return VectorStore(spark, built(rows, "vectors", lambda path: VectorStore.write(rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label"), path)))


def postings(spark: SparkSession, sf: str) -> TextIndex:
    docs = table(spark, sf, "documents")

    def write(path: str) -> None:
        arts = R.articles(docs).select("doc_id", F.concat_ws(" ", "title", "summary").alias("indexed"))
        TextIndex.write(arts, search_tokens("indexed"), path)

    return TextIndex(spark, built(docs, "postings", write))


def pieces(spark: SparkSession, sf: str) -> GramIndex:
    docs = table(spark, sf, "documents")
    return GramIndex(spark, built(docs, "pieces", lambda path: GramIndex.write(docs, path)))


def asked_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval._asked(spark, sf).select("qid", F.explode(search_tokens("text")).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))


def asked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@query("S17_vector_search", oracle_of("V04_dense_topk"))
def s17_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best ten by vector from the cells that can hold them."""
    return retrieval._rounded(vectors(spark, sf).search(asked_vectors(spark, sf), 10, exact=True))


@query("S17_vector_probe", f"WITH {retrieval.VEC} SELECT qid, rank, doc_id, round(score, 6) AS score FROM dr WHERE rank = 1")
def s17_probe(spark: SparkSession, sf: str) -> DataFrame:
    """The best of what the nearest cells hold: a query that is stored itself is found in its own cell."""
    return retrieval._rounded(vectors(spark, sf).search(asked_vectors(spark, sf), 10).where("rank = 1"))


@query("K08_bm25_blocks", oracle_of("V01_bm25"))
def k08_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 from the stored blocks, with the early stop by bounds."""
    return retrieval._rounded(postings(spark, sf).search(asked_tokens(spark, sf), 10))


@query("X09_grep_index", oracle_of("X09_grep"))
def x09_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches as X09 from the documents that the pattern's pieces leave."""
    return R.grep(pieces(spark, sf).matching("license"), "license")


@query("X09_table_function", oracle_of("X09_grep"))
def x09_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches by a table function over the parts of a table as they lie, from SQL."""
    table_functions.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView(view := f"texts_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT id AS doc_id, n, start, excerpt FROM grep_rows(TABLE(SELECT doc_id AS id, text FROM {view}), 'license', 100, 5)")
