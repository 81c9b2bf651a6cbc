"""String, answer-matching and corpus-cleaning queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions import match, text
from trailforge.operators import etl
from trailforge.plans.registry import query
from trailforge.plans.retrieval import STOP
from trailforge.session import table


def project(name: str, source: str, columns: Callable[[], dict[str, Column]], sql: str, where: str | None = None) -> None:
    """A query that is a projection of one table."""

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, source)
        return (rows.where(where) if where else rows).select(*[c.alias(k) for k, c in columns().items()])


DOC = lambda: F.col("doc_id")
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\b(a|an|the)\\b', ' ', 'g'), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"
project("X01_search_tokens", "documents", lambda: {"doc_id": DOC(), "tokens": F.array_join(text.search_tokens("text"), " ")},
        f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)), ' ') AS tokens FROM documents")
project("X02_plain_tokens", "documents", lambda: {"doc_id": DOC(), "n": F.size(text.plain_tokens("text")).cast("long"), "h": F.md5(F.array_join(text.plain_tokens("text"), " ").cast("binary"))},
        "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS h FROM documents")
project("X03_long_words", "documents", lambda: {"doc_id": DOC(), "n": F.size(text.long_words("text")).cast("long")},
        "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda t: length(t) > 2)))::BIGINT AS n FROM documents")
project("X04_word_set", "documents", lambda: {"doc_id": DOC(), "words": F.array_join(F.sort_array(text.word_set("text")), " ")},
        "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))), ' ') AS words FROM documents")
project("X05_normalize_answer", "part", lambda: {"p_partkey": F.col("p_partkey"), "answer": text.normalize_answer(F.concat(F.lit("The "), "p_name", F.lit(", an  "), "p_brand", F.lit("!")))},
        "SELECT p_partkey, " + NORM.format("concat('The ', p_name, ', an  ', p_brand, '!')") + " AS answer FROM part")
project("X06_last_answer", "conversations", lambda: {"conv_id": F.col("conv_id"), "turn": F.col("turn"), "answer": text.last_answer(F.concat(F.lit("<answer>draft</answer>\n<answer> "), F.col("text"), F.lit("</answer> done")))},
        "SELECT conv_id, turn, trim(list_last(regexp_extract_all(concat('<answer>draft</answer>', chr(10), '<answer> ', text, '</answer> done'), '(?s)<answer>(.*?)</answer>', 1)), ' ') AS answer FROM conversations")
OBS = "concat('ID: Q', {0} % 50, ' see Q', {0} % 7, ' and ID:Q', {0} % 50, CASE WHEN {0} % 5 = 0 THEN ' Invalid call' ELSE '' END)"


def _observation(key: str) -> Column:
    c = F.col(key)
    return F.concat(F.lit("ID: Q"), c % 50, F.lit(" see Q"), c % 7, F.lit(" and ID:Q"), c % 50, F.when(c % 5 == 0, " Invalid call").otherwise(""))


project("X07_entity_ids", "events", lambda: {"event_id": F.col("event_id"), "labelled": F.array_join(text.labelled_ids(_observation("event_id")), ","), "every": F.array_join(text.any_ids(_observation("event_id")), ",")},
        "SELECT event_id, concat('Q', event_id % 50) AS labelled, CASE WHEN event_id % 50 = event_id % 7 THEN concat('Q', event_id % 50) ELSE concat('Q', event_id % 50, ',Q', event_id % 7) END AS every FROM events")
project("X08_error_flag", "events", lambda: {"event_id": F.col("event_id"), "is_error": text.is_error(_observation("event_id"))},
        f"SELECT event_id, regexp_matches(lower({OBS.format('event_id')}), 'error|invalid') AS is_error FROM events")
project("X10_head_and_tail", "documents", lambda: {"doc_id": DOC(), "h": F.md5(text.head_and_tail(F.col("text"), 4000, 2000, "\n...[truncated]...\n").cast("binary"))},
        "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN concat(left(text, 2000), chr(10), '...[truncated]...', chr(10), right(text, 2000)) ELSE text END) AS h FROM documents")
project("X11_snippets", "documents", lambda: {"doc_id": DOC(), "s120": text.snippet(F.col("text"), 120), "s77": text.snippet(F.col("text"), 77), "w60": text.at_word(F.col("text"), 60)},
        "SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(left(text, 120), '...') ELSE text END AS s120, CASE WHEN length(text) > 77 THEN concat(left(text, 77), '...') ELSE text END AS s77, CASE WHEN length(text) > 60 THEN regexp_replace(left(text, 60), '\\s+\\S*$', '') ELSE text END AS w60 FROM documents")
FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in text.PAGE_FAMILIES) + f" WHEN regexp_matches(html, '{text.SEARCH_INPUT}') THEN 'search' WHEN len(regexp_extract_all(html, '{text.LIST_ITEM}')) > 20 THEN 'results' WHEN regexp_matches(html, '{text.MODAL}') AND len(regexp_extract_all(html, '{text.LIST_ITEM}')) < 5 THEN 'modal' ELSE 'detail' END"
BARE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
project("X12_page_facts", "pages", lambda: {"page_id": F.col("page_id"), "title": F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), "text_hash": F.left(F.md5(text.without_tags("html").cast("binary")), F.lit(12)), "links": F.regexp_count("html", F.lit("<a ")).cast("long"), "images": F.regexp_count("html", F.lit("<img")).cast("long"), "elements": F.regexp_count("html", F.lit("<[a-zA-Z]")).cast("long"), "family": text.page_family(F.col("url"), F.col("html"))},
        f"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, left(md5({BARE}), 12) AS text_hash, len(regexp_extract_all(html, '<a '))::BIGINT AS links, len(regexp_extract_all(html, '<img'))::BIGINT AS images, len(regexp_extract_all(html, '<[a-zA-Z]'))::BIGINT AS elements, {FAMILY} AS family FROM pages")
project("D08_page_hash", "pages", lambda: {"page_id": F.col("page_id"), "h": F.left(F.md5(F.col("html").cast("binary")), F.lit(12))}, "SELECT page_id, left(md5(html), 12) AS h FROM pages")


def _goal() -> Column:
    """Goals of several shapes around the name of a part."""
    name, k = F.col("p_name"), F.col("p_partkey") % 8
    shapes = (("搜索商品，找到与「", "」相关的产品并购买"), ('please find "', '" and buy it'), ("Search for and buy ", "."), ("buy the cheapest ", ""), ("查看产品 ", " 后购买"), ("浏览搜索结果，识别展示了", "的商品并购买"), ("Browse it all and buy the  thing related to ", "，"), ("find the 'ab' ", ""))
    return F.coalesce(*[F.when(k == i, F.concat(F.lit(a), name, F.lit(b))) for i, (a, b) in enumerate(shapes)])


GOAL = "CASE p_partkey % 8 WHEN 0 THEN concat('搜索商品，找到与「', p_name, '」相关的产品并购买') WHEN 1 THEN concat('please find \"', p_name, '\" and buy it') WHEN 2 THEN concat('Search for and buy ', p_name, '.') WHEN 3 THEN concat('buy the cheapest ', p_name) WHEN 4 THEN concat('查看产品 ', p_name, ' 后购买') WHEN 5 THEN concat('浏览搜索结果，识别展示了', p_name, '的商品并购买') WHEN 6 THEN concat('Browse it all and buy the  thing related to ', p_name, '，') ELSE concat('find the ''ab'' ', p_name) END"
QUOTES = ["trim(regexp_extract(g, '" + q.replace("'", "''") + "', 1))" for q in text.QUOTED]
STRIPPED = "trim(g)"
for _pattern in [*text.WRAPPING_ZH, *(f"(?i){x}" for x in text.WRAPPING_EN)]:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', '', 'g')"
STRIPPED = f"trim(regexp_replace(regexp_replace({STRIPPED}, '" + f"^[{text.EDGES}]+|[{text.EDGES}]+$".replace("'", "''") + "', '', 'g'), '\\s+', ' ', 'g'))"
project("X13_rewrite_query", "part", lambda: {"p_partkey": F.col("p_partkey"), "query": text.rewrite_query(_goal())},
        f"SELECT p_partkey, coalesce({', '.join(f'CASE WHEN length({q}) > 3 THEN {q} END' for q in QUOTES)}, CASE WHEN regexp_matches(g, '(?i){'|'.join(text.DECISIONS)}') THEN g END, CASE WHEN length({STRIPPED}) >= 4 THEN {STRIPPED} END, g) AS query FROM (SELECT p_partkey, {GOAL} AS g FROM part)")
SHAPES = [f"regexp_replace(g, '{p}', '{r.replace('$1', chr(92) + '1')}')" for p, r in text.GOAL_SHAPES]
WORDS = "g"
for _old, _new in text.GOAL_WORDS:
    WORDS = f"replace({WORDS}, '{_old}', '{_new}')"
project("X14_clean_goal", "part", lambda: {"p_partkey": F.col("p_partkey"), "goal": text.clean_goal(_goal())},
        f"SELECT p_partkey, coalesce({', '.join(f'CASE WHEN {c} <> g THEN {c} END' for c in SHAPES)}, {WORDS}) AS goal FROM (SELECT p_partkey, {GOAL} AS g FROM part)")
DECOYS = ("购买", "商品", "购物车", "产品")
project("F21_decoy_scan", "part", lambda: {"p_partkey": F.col("p_partkey"), "residual": F.exists(F.array(*map(F.lit, DECOYS)), lambda w: F.contains(_goal(), w)), "after": F.exists(F.array(*map(F.lit, DECOYS)), lambda w: F.contains(text.clean_goal(_goal()), w))},
        "SELECT p_partkey, " + " OR ".join(f"contains(g, '{w}')" for w in DECOYS) + " AS residual, " + "(" + " OR ".join(f"contains(c, '{w}')" for w in DECOYS) + f") AS after FROM (SELECT p_partkey, g, coalesce({', '.join(f'CASE WHEN {c} <> g THEN {c} END' for c in SHAPES)}, {WORDS}) AS c FROM (SELECT p_partkey, {GOAL} AS g FROM part))")
project("X15_fact_text", "part", lambda: {"p_partkey": F.col("p_partkey"), "fact": text.fact_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.col("p_brand"))},
        "SELECT p_partkey, concat_ws(' — ', p_name, CASE WHEN p_size > 25 THEN p_type END, p_brand) AS fact FROM part")
project("X16_index_text", "part", lambda: {"p_partkey": F.col("p_partkey"), "entry": text.index_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" "), F.col("p_brand"))},
        "SELECT p_partkey, concat_ws(' | ', p_name, CASE WHEN p_size > 25 THEN p_type END, p_brand) AS entry FROM part")
project("X17_caption_hint", "documents", lambda: {"doc_id": DOC(), "hint": text.caption_hint(F.concat(F.when(DOC() % 2 == 0, "A photo of ").otherwise(""), F.col("text")))},
        "SELECT doc_id, CASE WHEN length(c) > 60 THEN regexp_replace(left(c, 60), '\\s+\\S*$', '') ELSE c END AS hint FROM (SELECT doc_id, text AS c FROM documents)")
project("X18_file_extension", "part", lambda: {"p_partkey": F.col("p_partkey"), "ext": text.file_extension(F.when(F.col("p_size") < 10, "image/png").when(F.col("p_size") < 20, "text/plain"), F.concat(F.lit("http://x/"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, ".JPEG?w=1").when(F.col("p_partkey") % 3 == 1, ".gif").otherwise("")))},
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN '.png' WHEN p_partkey % 3 = 1 THEN '.gif' ELSE '.jpg' END AS ext FROM part")
project("X19_format_result", "part", lambda: {"line": F.concat(F.lit("["), "p_partkey", F.lit("] "), F.upper("p_name"), F.lit(": "), text.snippet(F.col("p_type"), 6))},
        "SELECT concat('[', p_partkey, '] ', upper(p_name), ': ', CASE WHEN length(p_type) > 6 THEN concat(left(p_type, 6), '...') ELSE p_type END) AS line FROM part")
REPLY = "CASE o_orderstatus WHEN 'P' THEN 'valid: yes' WHEN 'F' THEN ' INVALID because' ELSE 'unclear' END"
project("X22_verdict", "orders", lambda: {"o_orderkey": F.col("o_orderkey"), "ok": text.verdict(F.when(F.col("o_orderstatus") == "P", "valid: yes").when(F.col("o_orderstatus") == "F", " INVALID because").otherwise("unclear"), "VALID", "INVALID")},
        "SELECT o_orderkey, o_orderstatus <> 'F' AS ok FROM orders")
project("X23_english_words", "documents", lambda: {"doc_id": DOC(), "n": text.english_words("text").cast("long")}, "SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]+'))::BIGINT AS n FROM documents")
project("X25_state_line", "events", lambda: {"event_id": F.col("event_id"), "state": text.state_line(F.concat(F.lit("Step\nState: "), "event_type", F.lit("\nAvailable actions: a, b")), "State"), "actions": text.state_line(F.concat(F.lit("Step\nState: "), "event_type", F.lit("\nAvailable actions: a, b")), "Available actions")},
        "SELECT event_id, regexp_extract(concat('Step', chr(10), 'State: ', event_type, chr(10), 'Available actions: a, b'), '(?m)^State:[ \\t]*(.*)$', 1) AS state, 'a, b' AS actions FROM events")
project("X27_image_tags", "pages", lambda: {"page_id": F.col("page_id"), "images": F.array_join(text.images_of("html"), " "), "rest": F.md5(F.regexp_replace("html", "<img[^>]*>", "").cast("binary"))},
        "SELECT page_id, array_to_string(regexp_extract_all(html, '<img[^>]*src=\"([^\"]*)\"', 1), ' ') AS images, md5(regexp_replace(html, '<img[^>]*>', '', 'g')) AS rest FROM pages")

# answer matching: a prediction from a part's name and brand, a gold answer from the name alone, with articles and stops
PRED, GOLD = "CASE p_partkey % 4 WHEN 0 THEN concat('The ', p_name, '.') WHEN 1 THEN concat('in the ', p_name, ', ', p_brand) WHEN 2 THEN p_brand ELSE '' END", "p_name"


def _prediction() -> Column:
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("The "), "p_name", F.lit("."))).when(k == 1, F.concat(F.lit("in the "), "p_name", F.lit(", "), "p_brand")).when(k == 2, F.col("p_brand")).otherwise("")


def _from_pairs(columns: str) -> str:
    return f"SELECT p_partkey, {columns} FROM (SELECT p_partkey, {PRED} AS p, p_name AS g FROM part)"


EITHER = "(contains({a}, {b}) OR contains({b}, {a}))"
LOWP, LOWG = "rtrim(trim(lower(p)), '.')", "rtrim(trim(lower(g)), '.')"
CUT = "trim(replace(replace(replace({0}, 'the ', ''), 'a ', ''), 'an ', ''))"
project("M01_probe_match", "part", lambda: {"p_partkey": F.col("p_partkey"), "ok": match.probe_match(_prediction(), F.col("p_name"))},
        _from_pairs(f"{EITHER.format(a=LOWP, b=LOWG)} OR {CUT.format(LOWP)} = {CUT.format(LOWG)} AS ok"))
NP, NG = NORM.format("p"), NORM.format("g")
project("M02_three_matches", "part", lambda: {"p_partkey": F.col("p_partkey"), "exact": match.three_matches(_prediction(), F.col("p_name"))["exact"], "contained": match.three_matches(_prediction(), F.col("p_name"))["contained"], "normalised": match.three_matches(_prediction(), F.col("p_name"))["normalised"]},
        _from_pairs(f"trim(lower(p)) = trim(lower(g)) AS exact, {EITHER.format(a='trim(lower(p))', b='trim(lower(g))')} AS contained, {NP} = {NG} AS normalised"))
project("M03_answer_score", "part", lambda: {"p_partkey": F.col("p_partkey"), "score": match.answer_score(F.concat(F.repeat(F.lit("<answer>x</answer>"), (F.col("p_partkey") % 13).cast("int")), F.lit("<answer>"), _prediction(), F.lit("</answer>")), F.array(F.col("p_name"), F.lit("zzz")))},
        _from_pairs(f"(CASE WHEN {NP} = {NG} OR {NP} = 'zzz' THEN 1.0::DOUBLE WHEN contains({NP}, {NG}) OR contains({NP}, 'zzz') THEN 0.5 ELSE 0 END) / (CASE WHEN p_partkey % 13 + 1 > 10 THEN 4 ELSE 1 END) AS score"))
SETS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
project("M04_overlap_match", "part", lambda: {"p_partkey": F.col("p_partkey"), "ok": match.overlap_match(_prediction(), F.col("p_name"))},
        _from_pairs(f"trim(p) <> '' AND ({EITHER.format(a='trim(lower(p))', b='trim(lower(g))')} OR len(list_intersect({SETS.format('p')}, {SETS.format('g')}))::DOUBLE / len(list_distinct(list_concat({SETS.format('p')}, {SETS.format('g')}))) > 0.7) AS ok"))
project("M05_agent_match", "part", lambda: {"p_partkey": F.col("p_partkey"), "ok": match.agent_match(_prediction(), F.col("p_name"))},
        _from_pairs(f"trim(p) <> '' AND {EITHER.format(a='trim(lower(p))', b='trim(lower(g))')} AS ok"))
project("M06_list_match", "part", lambda: {"p_partkey": F.col("p_partkey"), "em": match.list_match(_prediction(), F.array(F.col("p_name"), F.col("p_brand")))["em"], "sub": match.list_match(_prediction(), F.array(F.col("p_name"), F.col("p_brand")))["sub"]},
        f"SELECT p_partkey, {NP} = {NG} OR {NP} = {NORM.format('b')} AS em, contains({NP}, {NG}) OR contains({NP}, {NORM.format('b')}) AS sub FROM (SELECT p_partkey, {PRED} AS p, p_name AS g, p_brand AS b FROM part)")

# corpus cleaning: documents stand for captions and articles
project("F01_quality_v1", "documents", lambda: {"doc_id": DOC()}, "SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) >= 10 AND n_chars >= 200", where="lang = 'en' AND length(text) >= 10 AND try_cast(n_chars AS int) >= 200")
project("F03_quality_v3", "documents", lambda: {"doc_id": DOC()}, "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 20 AND length(string_split(text, chr(10))[1]) > 2", where="text IS NOT NULL AND length(text) > 20 AND length(substring_index(text, '\\n', 1)) > 2")
LANGS = "['fr', 'en', lang]"
project("F04_language_pick", "documents", lambda: {"doc_id": DOC(), "caption": etl.pick_language(F.array(F.lit("fr"), F.lit("en"), F.col("lang")), F.array(F.lit(None).cast("string"), F.when(DOC() % 2 == 0, F.col("text")).otherwise(F.lit("short")), F.col("text")), F.array(F.lit("x"), F.concat(F.lit("t"), DOC()), F.lit("z")))["caption"]},
        "SELECT doc_id, text AS caption FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'short' FROM documents WHERE doc_id % 2 = 1")
CATS = "['animal', 'building', 'ring', 'tion']"
project("F05_category_tags", "documents", lambda: {"doc_id": DOC(), "tags": F.array_join(etl.category_tags(F.col("text"), ("animal", "building", "ring", "tion")), ",")},
        f"SELECT doc_id, array_to_string(list_filter({CATS}, lambda k: contains(lower(text), k)), ',') AS tags FROM documents")
project("D09_stable_ids", "pages", lambda: {"a": F.concat(F.lit("wit_"), F.left(F.md5(F.concat_ws("|", "url", F.lit("t")).cast("binary")), F.lit(12))), "b": F.left(F.md5(F.col("url").cast("binary")), F.lit(8))},
        "SELECT concat('wit_', left(md5(concat_ws('|', url, 't')), 12)) AS a, left(md5(url), 8) AS b FROM pages")
project("D15_hash_bucket", "part", lambda: {"p_partkey": F.col("p_partkey"), "bucket": etl.hash_bucket(F.col("p_name"), 7)},
        "SELECT p_partkey, (('0x' || left(md5(p_name), 8))::UBIGINT % 7)::BIGINT AS bucket FROM part")
project("S06_image_path", "part", lambda: {"path": etl.image_path(F.concat(F.lit("Q"), "p_partkey"))},
        "SELECT concat(CASE WHEN length(q) <= 4 THEN q ELSE left(q, 4) END, '/', q, '.jpg') AS path FROM (SELECT concat('Q', p_partkey) AS q FROM part)")


@query("F06_prioritised_fill", "SELECT doc_id, tagged FROM (SELECT doc_id, contains(lower(text), 'license') AS tagged FROM documents) ORDER BY tagged DESC, doc_id LIMIT 120")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return etl.prioritised(table(spark, sf, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("license")).alias("tagged")), "tagged", "doc_id", 120)


@query("D06_dedup_title", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY string_split(text, chr(10))[1] ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return etl.first_of(table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title")), ["title"], "doc_id").select("doc_id")


@query("D07_dedup_content", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("W15_first_wins", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    return etl.first_of(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id")


@query("A28_subset_stats", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS long_texts, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("long_texts"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_distinct("source").alias("sources"))


@query("W11_char_ngrams", """SELECT doc_id, n >= 1 AND u::DOUBLE / greatest(n, 1) < 0.5 AS repeats FROM (
SELECT doc_id, length(text) - 29 AS n, len(list_distinct(list_transform(range(1, greatest(length(text) - 28, 1)), lambda k: substring(text, k, 30)))) AS u FROM documents)""")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", etl.repeats_itself(F.col("text"), 30, 0.5).alias("repeats"))


@query("X12_family_counts", f"SELECT family, count(*) AS n FROM (SELECT {FAMILY} AS family FROM pages) GROUP BY family")
def x12b(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(text.page_family(F.col("url"), F.col("html")).alias("family")).agg(F.count("*").alias("n"))


@query("W12_per_type_cap", "SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM (SELECT min(p_partkey) AS p_partkey, any_value(p_type) AS p_type FROM part GROUP BY p_type, p_size // 20)) WHERE n <= 3")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """One part of each type and place on a grid of 20, then the first three of each type."""
    parts = etl.first_of(table(spark, sf, "part").select("p_type", F.floor(F.col("p_size") / 20).alias("cell"), "p_partkey"), ["p_type", "cell"], "p_partkey")
    rank = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    return parts.withColumn("n", rank).where("n <= 3").select("p_type", "p_partkey")
