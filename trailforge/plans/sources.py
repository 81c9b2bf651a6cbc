"""Readers and sinks end to end: a query writes files of a reader's format from a table, reads them back, and is held
against the table. Files lie in the shared folder of spark.checkpoint.dir, a new one for each run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.operators import etl
from trailforge.operators.retrieval import bounded, term_frequencies
from trailforge.plans import retrieval, stores
from trailforge.plans.registry import query
from trailforge.session import scratch, table
from trailforge.sources import matrix, readers, sinks
from trailforge.streaming import results


def _lines(df: DataFrame, line: Column, path: str, **options: str) -> str:
    df.select(line.alias("value")).write.options(**options).text(path)
    return path


def _files(spark: SparkSession, path: str, files: dict[str, bytes]) -> str:
    """A few files of given names; for tables of a fixed size."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, data in files.items():
        place = hadoop.Path(f"{path}/{name}")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(data)
        out.close()
    return path


def article_lines(spark: SparkSession, sf: str) -> str:
    """Article lines of documents: every eleventh has no id, every third no picture, and some lines are no JSON."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    article = F.struct(F.when(k % 11 != 0, F.concat(F.lit("Q"), k)).alias("wikidata_id"), F.substring_index(text, "\n", 1).alias("wikipedia_title"), text.alias("wikipedia_content"), F.when(k % 3 != 0, F.concat(F.lit("http://x/"), k)).alias("wikipedia_image_url"), F.left(text, F.lit(readers.SUMMARY)).alias("wikipedia_summary"), F.lit(1).alias("unknown"))
    lines = d.select(F.explode(F.array_compact(F.array(F.to_json(article), F.when(k % 13 == 0, F.lit('{"wikidata_id": "Q1", '))))).alias("line"))
    return _lines(lines, F.col("line"), scratch(spark, "articles"))


@query("S01_articles", "SELECT concat('Q', doc_id) AS qid, string_split(coalesce(text, ''), chr(10))[1] AS title, left(coalesce(text, ''), 500) AS summary, md5(coalesce(text, '')) AS content FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 3 <> 0")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with an id and a picture from JSON lines; bad lines are skipped."""
    a = readers.articles(spark, article_lines(spark, sf), with_image=True)
    return a.select(F.col("wikidata_id").alias("qid"), F.col("wikipedia_title").alias("title"), F.col("wikipedia_summary").alias("summary"), F.md5(F.col("wikipedia_content").cast("binary")).alias("content"))


@query("S02_graph_articles", "SELECT concat('Q', doc_id) AS qid, string_split(coalesce(text, ''), chr(10))[1] AS title, left(coalesce(text, ''), 500) AS summary, doc_id % 3 <> 0 AS has_image FROM documents WHERE doc_id % 11 <> 0")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    a = readers.articles(spark, article_lines(spark, sf))
    return a.select(F.col("wikidata_id").alias("qid"), F.col("wikipedia_title").alias("title"), F.col("wikipedia_summary").alias("summary"), (F.col("wikipedia_image_url") != "").alias("has_image"))


@query("S03_triples", "SELECT concat('C', o_custkey) AS head, o_orderpriority AS relation, concat('O', o_orderkey) AS tail FROM orders WHERE o_orderkey % 4 NOT IN (0, 1)")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of two or four parts are dropped."""
    k = F.col("o_orderkey")
    parts = F.array_compact(F.array(F.concat(F.lit("C"), "o_custkey"), F.col("o_orderpriority"), F.when(k % 4 != 0, F.concat(F.lit("O"), k)), F.when(k % 4 == 1, F.lit("more"))))
    return readers.triples(spark, _lines(table(spark, sf, "orders"), F.array_join(parts, "\t"), scratch(spark, "triples")))


@query("S04_aliases", "SELECT concat('P', p_partkey) AS key, CASE WHEN p_partkey % 5 = 0 THEN concat('P', p_partkey) ELSE string_split(p_name, ' ')[1] END AS name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) END AS n FROM part WHERE p_partkey % 9 <> 0")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged lines: some keys have no alias, blank ones do not count, lines without a key are dropped."""
    k = F.col("p_partkey")
    parts = F.concat(F.array(F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("P"), k))), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), F.split("p_name", " "))))
    a = readers.aliases(spark, _lines(table(spark, sf, "part"), F.array_join(parts, "\t"), scratch(spark, "aliases")))
    return a.select("key", "name", F.size("aliases").cast("long").alias("n"))


@query("S05_listing", "SELECT concat('N', n_nationkey) AS qid, n_nationkey::BIGINT + 1 AS bytes, concat('N', n_nationkey % 3, '/N', n_nationkey, '.jpg') AS place FROM nation")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures in sub-folders; other files are not listed."""
    keys = [r["n_nationkey"] for r in table(spark, sf, "nation").select("n_nationkey").collect()]
    files = {f"N{k % 3}/N{k}.jpg": b"x" * (k + 1) for k in keys} | {"N0/notes.txt": b"no picture"}
    return readers.listing(spark, _files(spark, scratch(spark, "pictures"), files)).select("qid", "bytes", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("place"))


FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\r\"]+', ' ', 'g'), ' ')"
#: What the rows of a WIT file are made of, by column; the other columns are blank.
WIT_SQL = f"""SELECT coalesce(lang, '') AS language, concat('http://x/', doc_id, '.jpg') AS image_url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {FLAT} END AS caption, source AS mime, CASE WHEN doc_id % 7 = 0 THEN 'wide' ELSE (doc_id % 400)::VARCHAR END AS width, CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'True' END AS main, doc_id FROM documents"""


def wit_file(spark: SparkSession, sf: str, compression: str = "none") -> str:
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\r\"]+", " "))
    filled = {"language": F.coalesce("lang", F.lit("")), "page_url": F.concat(F.lit("http://x/"), k), "image_url": F.concat(F.lit("http://x/"), k, F.lit(".jpg")), "caption_reference_description": F.when(k % 5 == 0, "").otherwise(flat), "mime_type": F.col("source"), "original_height": F.lit("300"), "original_width": F.when(k % 7 == 0, "wide").otherwise((k % 400).cast("string")), "is_main_image": F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").otherwise("True")}
    line = F.concat_ws("\t", *[F.coalesce(filled.get(c, F.lit("")), F.lit("")) for c in readers.WIT])
    header = spark.range(1).select(F.lit("\t".join(readers.WIT)).alias("line"))
    return _lines(header.union(d.select(line.alias("line"))), F.col("line"), scratch(spark, "wit"), compression=compression)


@query("S07_wit_gzip", f"WITH w AS ({WIT_SQL}) SELECT image_url, language, md5(caption) AS caption FROM w")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    """Gzipped tab-separated files, one of them with a header."""
    return _wit(readers.wit(spark, wit_file(spark, sf, "gzip"), parts=8))


@query("S08_wit_rows", f"WITH w AS ({WIT_SQL}) SELECT image_url, language, md5(caption) AS caption FROM w WHERE doc_id % 2 = 0")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.wit(spark, wit_file(spark, sf))
    return _wit(rows.where(F.regexp_extract("image_url", r"(\d+)\.jpg$", 1).cast("long") % 2 == 0))


def _wit(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("image_url", blank("language").alias("language"), F.md5(blank("caption_reference_description").cast("binary")).alias("caption"))


@query("F02_quality_v2", f"WITH w AS ({WIT_SQL}) SELECT image_url FROM w WHERE language = 'en' AND caption <> '' AND try_cast(width AS INT) >= 200 AND main <> 'false'")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    """The quality filter on rows as the WIT reader gives them."""
    return readers.wit_quality(readers.wit(spark, wit_file(spark, sf))).select("image_url")


def wit_base_file(spark: SparkSession, sf: str) -> str:
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    parallel = lambda *values: F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    none = F.array().cast("array<string>")
    features = F.struct(F.when(k % 4 == 0, parallel("fr")).otherwise(parallel("de", "en")).alias("language"), parallel("seite", F.concat(F.lit("page "), k)).alias("page_title"), none.alias("section_title"), F.when(k % 5 == 0, parallel("nur", None)).otherwise(parallel("nur", F.concat(F.lit("caption "), k))).alias("caption_reference_description"), none.alias("caption_alt_text_description"), none.alias("context_section_description"), none.alias("context_page_description"))
    e.select(F.concat(F.lit("http://x/"), k).alias("image_url"), F.col("embedding").cast("array<float>").alias("embedding"), features.alias("wit_features")).write.parquet(path := scratch(spark, "base"))
    return path


@query("S10_wit_base", "SELECT concat('http://x/', vec_id) AS image_url, concat('caption ', vec_id) AS caption, concat('page ', vec_id) AS title, len(embedding)::BIGINT AS size FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id % 5 <> 0")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """Nested parallel arrays: English where it is present."""
    return readers.wit_base(spark, wit_base_file(spark, sf)).select("image_url", "caption", "title", F.size("embedding").cast("long").alias("size"))


@query("S11_parquet_columns", "SELECT conv_id, turn, role FROM conversations")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parquet_columns(spark, f"{sf.rstrip('/')}/conversations.parquet", "conv_id", "turn", "role")


@query("S12_stream_attempts", "SELECT concat('http://x/', vec_id) AS image_url FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id % 5 <> 0 ORDER BY vec_id LIMIT 25")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable rows of a stream of rows, in the order of their ids; a limit is the feature."""
    rows = readers.wit_base(spark, wit_base_file(spark, sf))
    return rows.orderBy(F.regexp_extract("image_url", r"(\d+)$", 1).cast("long")).limit(25).select("image_url")


@query("S13_title_index", "SELECT lower(trim(title)) AS title, max(qid) AS qid FROM (SELECT concat('Q', 100 + n_nationkey) AS qid, concat(' Title ', n_regionkey, ' ') AS title FROM nation) GROUP BY ALL")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    """A file that is one JSON map; of entries with one title the last wins."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()
    kb = {f"Q{100 + r['n_nationkey']}": {"title": f" Title {r['n_regionkey']} ", "content": "c", "image": None} for r in rows}
    path = _files(spark, scratch(spark, "kb"), {"kb.json": json.dumps(kb, indent=1).encode()})
    return readers.kb_map(spark, path).groupBy(F.lower(F.trim("title")).alias("title")).agg(F.max("qid").alias("qid"))


@query("S14_task_lines", "SELECT concat('t', o_orderkey) AS task_id, o_orderpriority AS difficulty, (o_orderkey % 9)::INT AS max_steps, concat('w', o_custkey) AS first_fact, 2::BIGINT AS facts FROM orders")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """Task lines with nested facts, read strictly; keys that the schema lacks are dropped."""
    fact = lambda name, primary: F.struct(F.concat(F.lit(name), "o_custkey").alias("wit_id"), F.lit("c").alias("caption"), F.lit(primary).alias("is_primary"))
    task = F.struct(F.concat(F.lit("t"), "o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("difficulty"), (F.col("o_orderkey") % 9).cast("int").alias("max_steps"), F.struct(F.array(fact("w", True), fact("v", False)).alias("facts")).alias("fact_set"), F.lit(1).alias("more"))
    rows = readers.jsonl(spark, _lines(table(spark, sf, "orders"), F.to_json(task), scratch(spark, "tasks")), readers.TASK, strict=True)
    return rows.select("task_id", "difficulty", "max_steps", F.col("fact_set.facts")[0]["wit_id"].alias("first_fact"), F.size("fact_set.facts").cast("long").alias("facts"))


@query("S15_benchmark_shapes", """SELECT concat('b', item_id) AS id, md5(text) AS question, CASE item_id % 4 WHEN 0 THEN concat('a', item_id) WHEN 1 THEN concat('a', item_id, '|z') WHEN 2 THEN concat('v', item_id) END AS answers FROM benchmark""")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, questions and answers under several names: a text, a list, an object, none at all; a line that is no JSON."""
    b, k = table(spark, sf, "benchmark"), F.col("item_id")
    own, a = F.concat(F.lit("b"), k), F.concat(F.lit("a"), k)
    line = F.when(k % 4 == 0, F.to_json(F.struct(own.alias("id"), F.col("text").alias("question"), a.alias("answer")))).when(k % 4 == 1, F.to_json(F.struct(own.alias("question_id"), F.col("text").alias("query"), F.array(a, F.lit("z")).alias("gold_answer")))).when(k % 4 == 2, F.to_json(F.struct(own.alias("qid"), F.col("text").alias("prompt"), F.struct(F.concat(F.lit("v"), k).alias("value")).alias("answers")))).otherwise(F.to_json(F.struct(own.alias("id"), F.col("text").alias("question"))))
    lines = b.select(line.alias("line")).union(spark.range(1).select(F.lit("no json").alias("line")))
    read = readers.benchmark(spark, _lines(lines, F.col("line"), scratch(spark, "benchmark")))
    return read.select("id", F.md5(F.col("question").cast("binary")).alias("question"), F.array_join("answers", "|").alias("answers"))


@query("S16_matrix", "SELECT vec_id AS doc_id, len(embedding)::BIGINT AS size, embedding[1]::FLOAT AS head FROM embeddings")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """A NumPy matrix with the ids of its rows, written in parts and read by ranges of rows."""
    matrix.write(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), path := scratch(spark, "matrix"))
    v = matrix.read(spark, path, columns="doc_id long, vec array<float>", rows=500)
    return v.select("doc_id", F.size("vec").cast("long").alias("size"), F.col("vec")[0].alias("head"))


@query("S17_vector_store", "SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS stored FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    """A store that is counted, and asked for rows by id; S17_vector_search asks it by vector."""
    store = stores.vectors(spark, sf)
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return store.get(ids).select(F.col("doc_id").alias("vec_id"), "label", F.lit(store.count()).cast("long").alias("stored"))


def screen_files(spark: SparkSession, sf: str) -> str:
    files = {}
    for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect():
        k = r["n_nationkey"]
        elements = [{"id": f"e{j}", "type": "button" if j % 2 else "link", "text": r["n_name"], "visible": (j + k) % 3 > 0, "bbox": {"x": j, "y": 2.5, "w": 10 * j, "h": 20}} for j in range(k % 4 + 1)]
        files[f"page_{k:02d}/screen_ir.json"] = json.dumps({"page_id": f"page_{k}", "url": f"http://x/{k}", "elements": elements}, indent=2).encode()
    return _files(spark, scratch(spark, "screens"), files)


@query("S18_component_index", "SELECT CASE WHEN j % 2 = 1 THEN 'button' ELSE 'link' END AS type, count(*) AS n, count(DISTINCT n_nationkey) AS pages FROM nation, range(4) r(j) WHERE j <= n_nationkey % 4 AND (j + n_nationkey) % 3 > 0 GROUP BY ALL")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """Visible components of all captures under a folder, by type."""
    e = readers.screens(spark, f"{screen_files(spark, sf)}/*").select("page_id", F.explode("elements").alias("e")).where("e.visible")
    return e.groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("S19_screens", "SELECT concat('page_', n_nationkey) AS page_id, concat('http://x/', n_nationkey) AS url, (n_nationkey % 4 + 1)::BIGINT AS elements, 200.0::DOUBLE * (n_nationkey % 4) AS last_area FROM nation")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    """Nested captures, one JSON object in a file."""
    last = F.element_at("elements", -1)["bbox"]
    return readers.screens(spark, f"{screen_files(spark, sf)}/*").select("page_id", "url", F.size("elements").cast("long").alias("elements"), (last["w"] * last["h"]).alias("last_area"))


# sinks


@query("K01_json_arrays", "SELECT p_partkey, p_name, p_size FROM part")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    sinks.json_arrays(p, path := scratch(spark, "arrays"), 300)
    return spark.read.schema(p.schema).json(path)


@query("K02_sft_lines", "SELECT conv_id, turn, role AS speaker, md5(text) AS value FROM conversations")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as lines of turns, written and read again."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    sinks.jsonl(table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("conversations")), path := scratch(spark, "sft"))
    kind = table(spark, sf, "conversations").schema
    lines = spark.read.schema(f"conv_id {kind['conv_id'].dataType.simpleString()}, conversations array<struct<turn:{kind['turn'].dataType.simpleString()},`from`:string,value:string>>").json(path)
    return lines.select("conv_id", F.explode("conversations").alias("c")).select("conv_id", "c.turn", F.col("c.from").alias("speaker"), F.md5(F.col("c.value").cast("binary")).alias("value"))


@query("K03_episodes", "SELECT event_id, event_type AS action, value AS amount FROM events")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """Action and parameters as one string of JSON in each line."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), F.struct(F.col("value").cast("double").alias("amount")).alias("params"))
    sinks.episodes(e, path := scratch(spark, "episodes"))
    c = F.from_json("completion", "action string, params struct<amount:double>")
    return spark.read.schema("event_id long, completion string").json(path).select("event_id", c.alias("c")).select("event_id", "c.action", "c.params.amount")


@query("K04_bundle", "SELECT 'meta' AS file, count(DISTINCT o_orderpriority) AS n, 2::BIGINT AS columns FROM orders UNION ALL SELECT 'light', count(*), 2 FROM orders UNION ALL SELECT 'full', count(*), 3 FROM orders")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    sinks.bundle(o, path := scratch(spark, "bundle"), ["o_orderkey", "o_orderpriority"], "o_orderpriority")
    read = {"meta": spark.read.json(f"{path}/meta"), "light": spark.read.json(f"{path}/light"), "full": spark.read.parquet(f"{path}/full")}
    rows = [df.agg(F.lit(name).alias("file"), F.count("*").alias("n"), F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in read.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("K07_vector_writer", "SELECT vec_id, label, len(embedding)::BIGINT AS size FROM embeddings")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the store that S17 asks, read from its cells."""
    return stores.vectors(spark, sf).rows().select(F.col("doc_id").alias("vec_id"), "label", F.size("vec").cast("long").alias("size"))


@query("K08_index_probe", f"WITH {retrieval.BM25} SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM post WHERE token IN (SELECT token FROM q) GROUP BY token")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """An inverted index is written once, dealt and sorted by token, and probed with the words of all benchmark texts."""
    from trailforge.functions.text import search_tokens

    arts = retrieval._arts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary").alias("t"))
    lengths = arts.select("doc_id", F.size(search_tokens("t")).alias("dl"))
    sinks.index(term_frequencies(arts, search_tokens("t")), lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), path := scratch(spark, "index"), 8)
    asked = retrieval._asked(spark, sf).select(F.explode(search_tokens("text")).alias("token")).distinct()
    return spark.read.parquet(f"{path}/postings").join(bounded(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("K09_snapshot", "SELECT concat('C', o_custkey) AS head, count(*) AS n FROM orders GROUP BY ALL")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """A built graph is written once and read by what follows."""
    built = table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("head"), F.lit("placed").alias("pid"), F.concat(F.lit("O"), "o_orderkey").alias("tail"))
    return sinks.snapshot(built, scratch(spark, "graph")).groupBy("head").agg(F.count("*").alias("n"))


@query("K10_appended", "SELECT o_orderkey, (o_orderkey % 3)::INT AS batch FROM orders")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """Results as they come, in three batches."""
    path, o = scratch(spark, "results"), table(spark, sf, "orders").select("o_orderkey")
    for k in range(3):
        sinks.append(o.where(F.col("o_orderkey") % 3 == k).withColumn("batch", F.lit(k)), path)
    return spark.read.parquet(path)


def saved(spark: SparkSession, sf: str) -> str:
    """Judged orders as they arrive, file by file, in two runs of one stream."""
    arrived, path, schema = scratch(spark, "arrived"), scratch(spark, "saved"), table(spark, sf, "orders").select("o_orderkey").schema
    o = table(spark, sf, "orders").select("o_orderkey")
    for k in (0, 1):
        o.where(F.col("o_orderkey") % 2 == k).repartition(3).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        results.save(stream.withColumn("hit", (F.col("o_orderkey") % 3 == 0).cast("int")), path, ("hit",))
    return path


@query("K10_stream", "SELECT o_orderkey, (o_orderkey % 3 = 0)::INT AS hit FROM orders")
def k10_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream has saved, each row once."""
    kind = table(spark, sf, "orders").schema["o_orderkey"].dataType.simpleString()
    return results.read(spark, saved(spark, sf), f"o_orderkey {kind}, hit int").drop("batch")


@query("K10_report", "SELECT count(*) AS evaluated, round(100.0 * sum((o_orderkey % 3 = 0)::INT)::DOUBLE / count(*), 6) AS hit FROM orders")
def k10_report(spark: SparkSession, sf: str) -> DataFrame:
    """The running accuracy from the sums of the batches."""
    return results.report(spark, saved(spark, sf), ("hit",))


@query("F20_missing_files", "SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose picture lies in the folder."""
    n = table(spark, sf, "nation").select("n_nationkey")
    files = {etl.image_folder(f"N{r['n_nationkey']}"): b"x" for r in n.collect() if r["n_nationkey"] % 4}
    listed = readers.listing(spark, _files(spark, scratch(spark, "kept"), files)).select("qid")
    return n.withColumn("qid", F.concat(F.lit("N"), "n_nationkey")).join(listed, "qid", "left_semi").select("n_nationkey")
