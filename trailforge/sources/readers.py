"""Readers with explicit schemas; bad rows are dropped or fatal, as asked, and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.operators.etl import pick_language

#: Fixed value: characters of an article that its summary keeps.
SUMMARY = 500
ARTICLE = "wikidata_id string, wikipedia_title string, wikipedia_content string, wikipedia_image_url string, wikipedia_summary string"
WIT = (
    "language page_url image_url page_title section_title hierarchical_section_title caption_reference_description caption_attribution_description "
    "caption_alt_text_description mime_type original_height original_width is_main_image attribution_passes_lang_id page_changed_recently "
    "context_page_description context_section_description"
).split()
TASK = "task_id string, goal string, difficulty string, ground_truth_wit_id string, max_steps int, difficulty_tags array<string>, fact_set struct<facts:array<struct<wit_id:string,caption:string,is_primary:boolean>>>"
WIT_BASE = (
    "image_url string, embedding array<float>, wit_features struct<language:array<string>,page_title:array<string>,section_title:array<string>,"
    "caption_reference_description:array<string>,caption_alt_text_description:array<string>,context_section_description:array<string>,context_page_description:array<string>>"
)
SCREEN = "page_id string, url string, elements array<struct<id:string,type:string,text:string,visible:boolean,bbox:struct<x:double,y:double,w:double,h:double>>>"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a schema; unknown keys are dropped, bad lines too unless strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def articles(spark: SparkSession, path: str, with_image: bool = False, cap: int | None = None) -> DataFrame:
    """Articles with an id, blanks for missing text."""
    rows = jsonl(spark, path, ARTICLE).na.fill("").where("wikidata_id <> ''")
    rows = rows.where("wikipedia_image_url <> ''") if with_image else rows
    return rows.limit(cap) if cap else rows


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail) of lines with exactly three tab-separated parts."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("head"), parts[1].alias("relation"), parts[2].alias("tail"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, aliases) of ragged lines; the name is the first alias or else the key."""
    parts = F.split("value", "\t")
    own = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a: a != "")
    return spark.read.text(path).where(parts[0] != "").select(parts[0].alias("key"), F.coalesce(F.try_element_at(own, F.lit(1)), parts[0]).alias("name"), own.alias("aliases"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(qid, path, bytes) of the pictures under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.jpg$", 1).alias("qid"), "path", F.col("length").alias("bytes"))


def wit(spark: SparkSession, path: str, parts: int | None = None, cap: int | None = None) -> DataFrame:
    """WIT rows of tab-separated files, header or not; gzip cannot be split, so rows are dealt anew if parts is given."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in WIT])
    rows = spark.read.schema(schema).csv(path, sep="\t", quote="", escape="").where("language IS NULL OR language <> 'language'")
    rows = rows.repartition(parts) if parts else rows
    return rows.limit(cap) if cap else rows


def wit_quality(rows: DataFrame) -> DataFrame:
    """English rows with an address, a caption, a size of 200 or more and a main image."""
    caption = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in WIT[6:9]])
    size = (F.expr("try_cast(original_width AS int)") >= 200) & (F.expr("try_cast(original_height AS int)") >= 200)
    return rows.where((F.col("language") == "en") & (F.col("image_url") != "") & caption.isNotNull() & size & F.col("is_main_image").isin("true", "True"))


def parquet_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only these columns leave the files."""
    return spark.read.parquet(path).select(*columns)


def wit_base(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """(image_url, caption, title, embedding) of the wanted language from parallel arrays."""
    f = "wit_features"
    picked: Column = pick_language(F.col(f"{f}.language"), F.col(f"{f}.caption_reference_description"), F.col(f"{f}.page_title"), language)
    return spark.read.schema(WIT_BASE).parquet(path).select("image_url", picked["caption"].alias("caption"), picked["title"].alias("title"), "embedding").where("caption IS NOT NULL")


def kb_map(spark: SparkSession, path: str) -> DataFrame:
    """(qid, title, content, image) of a file that is one JSON map."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,struct<title:string,content:string,image:string>>")).alias("qid", "e")).select("qid", "e.*")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answers) of benchmark lines whose ids and answers come under several names and shapes."""
    raw = spark.read.text(path)
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    answer = get("answer", "gold_answer", "answers")
    listed = F.when(answer.startswith("["), F.from_json(answer, "array<string>")).when(answer.startswith("{"), F.array(F.get_json_object(answer, "$.value"))).when(answer.isNotNull(), F.array(answer))
    return raw.where(F.get_json_object("value", "$").isNotNull()).select(get("id", "question_id", "qid").alias("id"), get("question", "query", "prompt").alias("question"), listed.alias("answers"))


def vectors(spark: SparkSession, path: str, id_column: str, vector_column: str) -> DataFrame:
    """(doc_id, vec) of a Parquet matrix."""
    return spark.read.parquet(path).select(F.col(id_column).alias("doc_id"), F.col(vector_column).cast("array<float>").alias("vec"))


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of given ids."""
    return rows.join(ids.select(key), key, "left_semi")


def screens(spark: SparkSession, path: str) -> DataFrame:
    """Page captures, one JSON object per file."""
    return spark.read.schema(SCREEN).option("multiLine", "true").json(path)
