"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.functions.text import STOPWORDS, plain_tokens, search_tokens, word_set
from trailforge.operators import metrics
from trailforge.operators import retrieval as R
from trailforge.plans.registry import query
from trailforge.session import table

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOK = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([" + STOP + "], t))"
ART = "art AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, left(coalesce(text, ''), 500) AS summary, coalesce(text, '') AS content, doc_id % 3 <> 0 AS has_image FROM documents)"
BM25 = f"""{ART},
dt AS (SELECT doc_id, {TOK.format("concat(title, ' ', summary)")} AS toks FROM art),
st AS (SELECT count(*) AS n, sum(len(toks)) / greatest(count(*), 1) AS avgdl FROM dt),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format("text")}) AS token FROM benchmark) GROUP BY ALL),
bm AS (
  SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM post JOIN q USING (token) JOIN df USING (token) JOIN dt USING (doc_id), st GROUP BY ALL
),
bmr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""
VEC = """qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
ds AS (
  SELECT qid, vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(v, v)) + 1e-8) AS score FROM embeddings, qv
),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds)"""


def _arts(spark: SparkSession, sf: str) -> DataFrame:
    return R.articles(table(spark, sf, "documents"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def sparse(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    arts = _arts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary").alias("indexed"))
    return R.bm25(arts, _asked(spark, sf), search_tokens("indexed"), search_tokens("text"), k)


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


@query("V01_bm25", f"WITH {BM25} SELECT qid, rank, doc_id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sparse(spark, sf))


TRUTH = "truth AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id) where a benchmark passage stands in a document: candidates by a shared rare word, then the whole passage."""
    docs, asked = table(spark, sf, "documents"), _asked(spark, sf)
    words = asked.select("qid", "text", F.array_max(F.transform(F.slice(F.split("text", r"\s+"), 2, F.greatest(F.lit(1), F.size(F.split("text", r"\s+")) - 2)), lambda w: F.struct(F.length(w).alias("l"), w.alias("w")))).alias("m"))
    probe = words.select("qid", F.col("text").alias("passage"), F.col("m.w").alias("word"))
    spread = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    return spread.join(R.bounded(probe), "word").where(F.contains("text", "passage")).select("qid", "doc_id")


@query("bm25_eval", f"""WITH {BM25}, {TRUTH},
best AS (SELECT qid, min(rank) AS rank FROM truth LEFT JOIN (SELECT * FROM bmr WHERE rank <= 10) r USING (qid, doc_id) GROUP BY qid)
SELECT count(*) AS n, {metrics.RECALL_SQL} FROM best""")
def bm25_eval(spark: SparkSession, sf: str) -> DataFrame:
    best = truth(spark, sf).join(sparse(spark, sf), ["qid", "doc_id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return metrics.recall_report(best)


@query("A03_term_stats", f"WITH {BM25} SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY token")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    arts = _arts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary").alias("t"))
    return R.term_frequencies(arts, search_tokens("t")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("A03_corpus_stats", f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def a03b(spark: SparkSession, sf: str) -> DataFrame:
    arts = _arts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary").alias("t"))
    return _rounded(R.corpus_stats(arts, search_tokens("t")), "avgdl")


OKAPI = """dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '') AS toks FROM documents),
st AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM dt),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY ALL),
raw AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, st GROUP BY token, n),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score FROM post JOIN q USING (token) JOIN idf USING (token) JOIN dt USING (doc_id), st GROUP BY ALL)"""


@query("V02_okapi", f"""WITH {OKAPI}, p AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS score FROM s WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p) SELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def v02(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.okapi(table(spark, sf, "documents"), _asked(spark, sf)))


MINI = BM25.replace(TOK.format("concat(title, ' ', summary)"), "regexp_extract_all(lower(concat(title, ' ', content)), '[a-z0-9]+')").replace(TOK.format("text"), "regexp_extract_all(lower(text), '[a-z0-9]+')")


@query("V03_mini_bm25", f"WITH {MINI} SELECT qid, rank, doc_id, round(bmr.score, 6) AS score, left(content, 300) AS summary FROM bmr JOIN art USING (doc_id) WHERE rank <= 5")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    arts = _arts(spark, sf)
    both = arts.select("doc_id", F.concat_ws(" ", "title", "content").alias("t"))
    found = R.bm25(both, _asked(spark, sf), plain_tokens("t"), plain_tokens("text"), 5)
    return _rounded(found).join(arts.select("doc_id", F.left("content", F.lit(300)).alias("summary")), "doc_id")


@query("V04_dense_topk", f"WITH {VEC} SELECT qid, rank, doc_id, round(score, 6) AS score FROM dr WHERE rank <= 10")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.dense(*_vectors(spark, sf)))


@query("T02_dense_holdout", f"""WITH {VEC}, h AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds WHERE qid <> doc_id)
SELECT qid, rank, doc_id, round(score, 6) AS score FROM h WHERE rank <= 5""")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.dense(*_vectors(spark, sf), k=5, exclude_self=True))


@query("V05_distance_score", f"WITH {VEC} SELECT qid, doc_id, CASE WHEN abs(1 - score) < 5e-7 THEN 0.0 ELSE round(1 - score, 6) END AS distance, round(greatest(0, 1 - (1 - score) / 2), 6) AS score FROM dr WHERE rank <= 20 AND 1 - score <= 1.0")
def v05(spark: SparkSession, sf: str) -> DataFrame:
    found = R.dense(*_vectors(spark, sf), k=20).withColumn("distance", 1 - F.col("score")).where("distance <= 1.0")
    zero = F.when(F.abs("distance") < 5e-7, 0.0).otherwise(F.round("distance", 6))
    return _rounded(found.select("qid", "doc_id", zero.alias("distance"), F.greatest(F.lit(0.0), 1 - F.col("distance") / 2).alias("score")))


@query("F08_distance_filter", f"WITH {VEC} SELECT qid, count(*) AS n FROM dr WHERE rank <= 100 AND 1 - score <= 0.9 GROUP BY qid")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense(*_vectors(spark, sf), k=100).where(1 - F.col("score") <= 0.9).groupBy("qid").agg(F.count("*").alias("n"))


@query("V06_mean_query", """WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] + x[2]) / 2) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM p""")
def v06(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    v = a.join(b, "vec_id").select("vec_id", R.mean_vector(F.col("embedding"), F.col("other")).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("V07_fused_vector", """WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: 0.6::DOUBLE * x[1] + 0.4::DOUBLE * x[2]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(1.0::DOUBLE, 6) AS norm FROM p""")
def v07(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    v = a.join(b, "vec_id").select("vec_id", R.fused_vector(F.col("embedding"), F.col("other")).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(R.norm(F.col("v")), 6).alias("norm"))


LISTS = f"""{BM25}, {VEC},
lists AS (SELECT qid, 'sparse' AS source, rank, doc_id, score FROM bmr WHERE rank <= 20 UNION ALL SELECT qid, 'dense', rank, doc_id, score FROM dr WHERE rank <= 20)"""


def lists(spark: SparkSession, sf: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    return R.dense(*_vectors(spark, sf), k=k), sparse(spark, sf, k)


@query("V08_hybrid_rrf", f"""WITH {LISTS}, sides AS (SELECT qid, count(DISTINCT source) AS n, min(source) AS side FROM lists GROUP BY qid),
f AS (SELECT qid, doc_id, CASE WHEN n = 2 THEN 'rrf' ELSE side END AS mode, sum(CASE WHEN n = 2 THEN 1.0::DOUBLE / (60 + rank) ELSE score END) AS score FROM lists JOIN sides USING (qid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT qid, rank, doc_id, mode, round(score, 6) AS score FROM r WHERE rank <= 10""")
def v08(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.hybrid(*lists(spark, sf)).select("qid", "rank", "doc_id", "mode", "score"))


@query("J10_rrf_fuse", f"""WITH {LISTS}, f AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    a, b = lists(spark, sf)
    return _rounded(R.rrf(a.unionByName(b)))


@query("D03_max_merge", f"""WITH {LISTS}, f AS (SELECT qid, doc_id, max(score) AS score FROM lists GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    a, b = lists(spark, sf)
    return _rounded(R.max_merge(a.unionByName(b), 10))


@query("F07_post_filter", f"WITH {BM25} SELECT qid, rank, bmr.doc_id, round(bmr.score, 6) AS score FROM bmr JOIN art USING (doc_id) WHERE rank <= 20 AND has_image AND contains(lower(title), 'th') AND length(content) >= 200")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.post_filter(sparse(spark, sf, 20), _arts(spark, sf), has_image=True, title_contains="th", min_length=200))


KB = """kt AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'))) AS token, 3.0::DOUBLE AS points FROM art
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(left(content, 500)), '[\\p{L}\\p{N}_]+'))), 1.0 FROM art),
kq AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS token FROM asked),
ks AS (SELECT qid, doc_id, sum(points) AS score FROM kt JOIN kq USING (token) GROUP BY ALL),
ke AS (SELECT qid, min(doc_id) AS doc_id FROM asked JOIN art ON lower(trim(title)) = lower(trim(text)) GROUP BY qid),
kr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ks WHERE qid NOT IN (SELECT qid FROM ke))"""


@query("V09_kb_search", f"""WITH {ART}, asked AS (SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, title FROM art WHERE doc_id % 20 = 0),
{KB} SELECT qid, rank::INT AS rank, doc_id, score FROM kr WHERE rank <= 5 UNION ALL SELECT qid, 1, doc_id, 1.0 FROM ke""")
def v09(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts and the titles of all documents due as queries (ids divisible by 20), asked of all documents."""
    arts = _arts(spark, sf)
    asked = _asked(spark, sf).unionByName(arts.where("doc_id % 20 = 0").select((F.col("doc_id") + 1000000).alias("qid"), F.col("title").alias("text")))
    return R.title_search(arts, asked, word_set, 5)


@query("V10_token_overlap", f"""WITH {ART}, p AS (SELECT a.doc_id, list_distinct(regexp_extract_all(lower(a.summary), '[a-z0-9]+')) AS s, list_distinct(regexp_extract_all(lower(b.summary), '[a-z0-9]+')) AS t FROM art a JOIN art b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, len(list_intersect(s, t)) AS common, round_even(len(list_intersect(s, t))::DOUBLE / greatest(1, least(len(s), len(t))), 3) AS overlap FROM p""")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    a = _arts(spark, sf).select("doc_id", F.array_distinct(plain_tokens("summary")).alias("s"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return a.join(b, "doc_id").select("doc_id", common.cast("long").alias("common"), F.bround(common.cast("double") / F.greatest(F.lit(1), F.least(F.size("s"), F.size("t"))), 3).alias("overlap"))


@query("V11_compare", f"""WITH {ART} SELECT a.doc_id AS a, b.doc_id AS b, left(a.content, 100) AS preview_a, left(b.content, 100) AS preview_b, length(a.content) AS length_a, length(b.content) AS length_b,
contains(lower(a.content), 'tion') AS aspect_a, contains(lower(b.content), 'tion') AS aspect_b FROM art a JOIN art b ON b.doc_id = a.doc_id + 7""")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    """Each article beside the one seven ids on."""
    arts = _arts(spark, sf)
    side = lambda s: [F.left("content", F.lit(100)).alias(f"preview_{s}"), F.length("content").cast("long").alias(f"length_{s}"), F.contains(F.lower("content"), F.lit("tion")).alias(f"aspect_{s}")]
    a = arts.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 7).alias("b"), *side("a"))
    return a.join(arts.select(F.col("doc_id").alias("b"), *side("b")), "b")


GOLD = "gold AS (SELECT item_id AS qid, item_id * 3 AS doc_id FROM benchmark)"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") * 3).alias("doc_id"))


@query("T05_boost", f"""WITH {BM25}, {GOLD}, s AS (SELECT qid, doc_id, CASE WHEN g.qid IS NOT NULL THEN score * 2.0 ELSE score END AS score FROM bmr LEFT JOIN gold g USING (qid, doc_id) WHERE rank <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.boost(sparse(spark, sf, 30), _gold(spark, sf), 2.0, 5))


@query("D17_inject_gold", f"""WITH {BM25}, {GOLD}, s AS (SELECT qid, doc_id, score FROM bmr WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 1.5 FROM gold g WHERE NOT EXISTS (SELECT 1 FROM bmr WHERE rank <= 10 AND bmr.qid = g.qid AND bmr.doc_id = g.doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT qid, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 12""")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.inject_gold(sparse(spark, sf, 10), _gold(spark, sf), 3.0, 12))


@query("D16_inject_last", f"""WITH {BM25}, {GOLD}, m AS (SELECT b.qid, b.rank, b.doc_id, g.doc_id AS gold_id, max(b.doc_id = g.doc_id) OVER (PARTITION BY b.qid) AS has, max(rank) OVER (PARTITION BY b.qid) AS last FROM bmr b LEFT JOIN gold g ON g.qid = b.qid WHERE rank <= 6)
SELECT qid, rank, CASE WHEN rank = last AND NOT has THEN gold_id ELSE doc_id END AS doc_id, rank = last AND NOT has AS injected FROM m""")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    return R.replace_last(sparse(spark, sf, 6), _gold(spark, sf))


@query("X09_grep", """WITH p AS (SELECT doc_id, text, string_split(lower(text), 'license') AS pieces FROM documents WHERE contains(lower(text), 'license')),
s AS (SELECT doc_id, text, k AS n, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::INT + (k - 1)::INT * 7 AS start FROM (SELECT *, unnest(range(1, least(len(pieces), 6))) AS k FROM p))
SELECT doc_id, n, start, concat(CASE WHEN start > 100 THEN '...' ELSE '' END, substring(text, greatest(start - 100, 0) + 1, least(start + 107, length(text)) - greatest(start - 100, 0)), CASE WHEN start + 107 < length(text) THEN '...' ELSE '' END) AS excerpt FROM s""")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    return R.grep(table(spark, sf, "documents"), "license")
