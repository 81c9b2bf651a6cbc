"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trailforge.llm import bpe, collocate, decontam, embdedup, jaccard, langid, linededup, lm, packing, spelling, substring, toxicity, unitdedup
from trailforge.llm.bpe import tokenizer_path
from trailforge.session import table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(table(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: Words as the operator takes them, in SQL.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM t),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id,
         CASE WHEN n3.n IS NOT NULL THEN n3.n / h2.n
              WHEN n2.n IS NOT NULL THEN (CASE WHEN g.a IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * n2.n / h1.n
              ELSE (CASE WHEN g.a IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * (CASE WHEN g.b IS NOT NULL THEN 0.4::DOUBLE ELSE 1 END) * n1.n / total.n END AS p
  FROM g JOIN n1 ON n1.c = g.c CROSS JOIN total
  LEFT JOIN n2 ON n2.b = g.b AND n2.c = g.c LEFT JOIN n1 h1 ON h1.c = g.b
  LEFT JOIN n3 ON n3.a = g.a AND n3.b = g.b AND n3.c = g.c LEFT JOIN n2 h2 ON h2.b = g.a AND h2.c = g.b
), sums AS (SELECT doc_id, sum(ln(p)) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(coalesce(x, 0), 5) AS log_score, round(x / len(w), 6) AS mean_log_score
FROM d LEFT JOIN sums USING (doc_id)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = langid.predict_documents(docs, langid.fit(docs))
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0
), grams AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM win),
places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, p, grams.n, item_id
  FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM places) x JOIN grams ON grams.n = x.n AND grams.g = x.g
), hitwords AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
hititems AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
), dt AS (
  SELECT doc_id, unnest(range(1, len(w))) AS p, w FROM d WHERE len(w) > 1
), dterms AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] AS t FROM dt UNION ALL SELECT doc_id, p, w[p] FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, w FROM d)
), bt AS (
  SELECT DISTINCT i, item_id, t FROM (
    SELECT i, item_id, w[q] || ' ' || w[q + 1] AS t FROM (SELECT row_number() OVER () AS i, item_id, w, unnest(range(1, len(w))) AS q FROM b WHERE len(w) > 1)
    UNION ALL SELECT -row_number() OVER (), item_id, w[1] FROM b WHERE len(w) = 1)
), f AS (SELECT t, count(*) AS f FROM dterms GROUP BY t),
rare AS (
  SELECT i, item_id, t, k, n FROM (
    SELECT bt.i, bt.item_id, bt.t, f.f, row_number() OVER (PARTITION BY bt.i ORDER BY f.f IS NULL, f.f, bt.t) AS k, count(*) OVER (PARTITION BY bt.i) AS n
    FROM bt LEFT JOIN f USING (t)) WHERE k <= 2 AND f IS NOT NULL
), lists AS (SELECT doc_id, i, item_id, k, n, p FROM rare JOIN dterms USING (t)),
near AS (
  SELECT doc_id, item_id FROM lists WHERE n = 1
  UNION
  SELECT x.doc_id, x.item_id FROM lists x JOIN lists y ON x.doc_id = y.doc_id AND x.i = y.i AND x.k = 1 AND y.k = 2 AND abs(x.p - y.p) <= 10
), nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hitwords USING (doc_id) LEFT JOIN hititems USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest_columns(linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = unitdedup.dedup_units(table(spark, sf_dir, "documents"), min_words=8)
    return cut.select("doc_id", "n_chars", "n_removed", "n_spans", "removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that tells rows of one doc_id apart is left out: it is the operator's own."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), size=5, threshold=0.8).drop("text_digest")


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, least(len(w), 5) AS size, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.size = b.size AND a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(n_links, 0)::BIGINT AS n_links, class_id FROM documents JOIN class ON class.a = doc_id LEFT JOIN counted ON counted.a = doc_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; runs of removed bytes are merged from the windows that cover them.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
firsts AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT w.doc_id, p FROM w JOIN firsts USING (s) WHERE least < w.doc_id),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS fresh FROM gone),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
r AS (SELECT doc_id, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb, sum(b - a) AS removed FROM runs GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(len(aa), 0) AS n_spans,
         array_to_string(list_transform(range(1, coalesce(len(aa), 0) + 2), lambda k: substr(h, 2 * coalesce(bb[k - 1], 0) + 1, 2 * (coalesce(aa[k], len(h) // 2) - coalesce(bb[k - 1], 0)))), '') AS kept
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM kept
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, ratio=2)


#: The draw is a crc32 bit by bit, least bit first; a code point of a run is one byte or two in UTF-8.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs GROUP BY doc_id, run),
coded AS (
  SELECT run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM each
), drawn AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(b, lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: ((x >> i) & 1)::BIGINT)))),
    lambda c, bit: xor(c >> 1, 3988292384::BIGINT * (xor(c, bit) & 1))), 4294967295::BIGINT) AS h FROM coded
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM drawn
), v AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3), without AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word AS a, b.word AS b FROM without a JOIN without b ON a.i = b.i AND a.k = b.k WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, v.word FROM without a JOIN v ON v.word = a.k
  UNION SELECT v.word, a.word FROM without a JOIN v ON v.word = a.k
), ranked AS (
  SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k FROM near JOIN v ON v.word = b
), forms AS (
  SELECT v.word, CASE WHEN r.n >= 2 * v.n THEN r.b END AS form, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.a = v.word AND r.k = 1
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL
), roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k)) GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_phrases AS (
  SELECT c.lang, c.a AS around, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS k) WHERE k < size) c
), covered AS (SELECT lang, phrase, max(around) AS around FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT c.* FROM c LEFT JOIN covered USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a),
cuts AS (
  SELECT kept.lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) kept
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score,
         row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 1000 * a * n // (x.f * y.f), cuts.k) AS place
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE place = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": op1_lm,
        "op4_langid": op4_langid,
        "op5_decontam": op5_decontam,
        "op6_packing": op6_packing,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op8_unit_dedup": op8_unit_dedup,
        "op2_bpe": op2_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op11_spelling": op11_spelling,
        "op12_collocations": op12_collocations,
        "op13_toxicity": op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_lm": OP1_SQL,
        "op9_embedding_dedup": OP9_SQL,
        "op5_decontam": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op3_ngram_jaccard": OP3_SQL,
        "op10_suffix_dedup": OP10_SQL,
        "op11_spelling": OP11_SQL,
        "op12_collocations": OP12_SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
