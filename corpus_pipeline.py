"""A corpus pipeline over documents: each stage reads what the stage before it kept.

Language ID lets go of documents without letters or without a language that is likelier than not; line dedup takes
frequent lines out of texts; the Jaccard join keeps the first document of each class; decontamination lets go of
documents that the benchmark covers; encoding returns ids and digests of what is left. All but the last return the
columns of documents.

Defined cases: rows are judged each by itself, whether their doc_id is null, repeats or is unique; a null or empty text
has no letters and goes at the first stage; a text that loses all of its lines is empty from then on and stays; of equal
rows one stays; an empty table passes through; extra columns, also of names that operators use, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.llm import bpe, decontam, jaccard, langid, linededup
from trailforge.llm.bpe import tokenizer_path
from trailforge.llm.common import bounded, checkpoint, reused
from trailforge.session import table

MIN_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id",))
    said = langid.predict_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), langid.fit(docs), carry=others, prefix="__")
    return said.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = linededup.dedup_lines(docs, min_docs=10, min_chars=1, carry=others, prefix="__")
    changed = {"text": F.when(F.col("__n_dropped") > 0, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__n_dropped") > 0, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(changed).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a key __key of each row, and the keys that several rows have, if there are any: decisions are on rows, as a doc_id
    may be null or repeat. Rows of one key have one doc_id and one text, so they are judged alike; should two others ever
    share a key, a second hash tells, and rows are numbered through a checkpoint instead."""
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    other = F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id"))
    again = rows.groupBy("__key").agg(F.count("*").alias("n"), F.min(other).alias("low"), F.max(other).alias("high")).where("n > 1")
    again = reused(again)
    if again.isEmpty():
        return rows, None
    if not again.where("low <> high").isEmpty():
        return checkpoint(docs.withColumn("__key", F.monotonically_increasing_id())), None
    return rows, again.select("__key")


def keep_first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of least doc_id, a null one last, and then of least hash of its text."""
    rows, again = keyed(docs)
    classes = jaccard.jaccard_join(rows.select(F.col("__key").alias("doc_id"), "text"), size=5, threshold=0.8).groupBy(F.col("doc_id").alias("__key")).agg(F.min("class_id").alias("__class"))
    doc_id = F.col("doc_id").cast("long")
    place = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64("text").alias("hash"), F.col("__key").alias("row"))
    placed = reused(rows.groupBy("__key").agg(F.min(place).alias("__place")).join(classes, "__key"))
    first = placed.groupBy("__class").agg(F.min("__place")["row"].alias("__first"))
    gone = placed.join(first, "__class").where("__key <> __first").select("__key")
    kept = rows.join(bounded(gone), "__key", "left_anti")
    if again is not None:  # of equal rows one
        kept = kept.join(again, "__key", "left_anti").unionByName(kept.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = keyed(docs)
    judged = decontam.judge_documents(rows.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), n=13)
    gone = reused(judged.where("contaminated").select(F.col("doc_id").alias("__key")).distinct())
    return rows.join(bounded(gone), "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path(), words_kept=bpe.FEWER_WORDS_KEPT)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_frequent_lines),
    ("jaccard_join", keep_first_of_class),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: The network and the encoder are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are cut off in the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
