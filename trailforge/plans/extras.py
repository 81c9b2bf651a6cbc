"""Queries over readers' shapes, transcripts, providers and synthesis templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions import calls, providers, transcripts
from trailforge.operators import etl, graph
from trailforge.plans import retrieval
from trailforge.plans.graph import links, nodes, with_fan
from trailforge.plans.registry import query
from trailforge.session import table


@query("S09_column_scan", "SELECT doc_id, lang FROM documents")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang")


@query("J09_postings_probe", f"WITH {retrieval.BM25} SELECT qid, count(*) AS postings, sum(tf)::BIGINT AS tf FROM post JOIN q USING (token) GROUP BY qid")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    from trailforge.functions.text import search_tokens
    from trailforge.operators.retrieval import bounded, term_frequencies

    arts = retrieval._arts(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary").alias("t"))
    asked = retrieval._asked(spark, sf).select("qid", F.explode(F.array_distinct(search_tokens("text"))).alias("token"))
    return term_frequencies(arts, search_tokens("t"), asked).join(bounded(asked), "token").groupBy("qid").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


@query("J15_title_overlap", "WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+')) AS s FROM documents), q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) SELECT item_id, max(len(list_intersect(s, t))) AS best FROM a, q GROUP BY item_id")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """The largest overlap of a query with any title: rare tokens first, frequent ones only to count."""
    from trailforge.functions.text import plain_tokens
    from trailforge.operators.retrieval import best_overlap

    titles = table(spark, sf, "documents").select("doc_id", F.array_distinct(plain_tokens(F.substring_index("text", "\n", 1))).alias("tokens"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(plain_tokens("text")).alias("tokens"))
    return best_overlap(titles, asked).select(F.col("qid").alias("item_id"), "best")


@query("W01_ranks", f"WITH {retrieval.BM25} SELECT qid, max(rank) AS last FROM bmr WHERE rank <= 50 GROUP BY qid")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sparse(spark, sf, 50).groupBy("qid").agg(F.max("rank").alias("last"))


@query("T01_bm25_top1", f"WITH {retrieval.BM25} SELECT qid, doc_id FROM bmr WHERE rank = 1")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sparse(spark, sf, 1).select("qid", "doc_id")


@query("T03_dense_top1", f"WITH {retrieval.VEC} SELECT qid, doc_id FROM dr WHERE rank = 1")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    from trailforge.operators.retrieval import dense

    return dense(*retrieval._vectors(spark, sf), k=1).select("qid", "doc_id")


@query("V30_mock_embedding")
def v30(spark: SparkSession, sf: str) -> DataFrame:
    return providers.embed_column(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "vec", providers.HashEmbedding)


@query("N03_tool_calls", """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN 'visit' WHEN 4 THEN 'open' ELSE 'search' END AS name, CASE event_id % 6
  WHEN 0 THEN concat('{"k": ', json_extract_string(props, '$.k'), '}') WHEN 1 THEN concat('{"q": "a } b", "user": {"id": ', user_id, '}}') WHEN 2 THEN '{}' WHEN 3 THEN concat('{"n": "', user_id, '", "q": "say \\"hi\\", twice"}') WHEN 4 THEN concat('{"x": "', event_type, '"}') ELSE '{}' END AS arguments FROM events""")
def n03(spark: SparkSession, sf: str) -> DataFrame:
    """Six shapes: a tagged call, one with braces in strings and objects, one without arguments, a call in words with quotes and
    escapes, other names for the parts, and no call at all."""
    k, u = F.col("event_id"), F.col("user_id")
    shapes = (
        F.concat(F.lit('go <tool_call>{"name": "search", "arguments": '), "props", F.lit("}</tool_call>")),
        F.concat(F.lit('{not json} <tool_call> {"name": "search", "arguments": {"user": {"id": '), u, F.lit('}, "q": "a } b"}} </tool_call> {"name": "late"}')),
        F.lit('I will {"name": "search"} now'),
        F.concat(F.lit('Action: visit(q="say \\"hi\\", twice", n='), u, F.lit(")")),
        F.concat(F.lit('{"tool": "open", "args": {"x": "'), "event_type", F.lit('"}}')),
        F.lit("nothing (here} to { call"),
    )
    text = F.coalesce(*[F.when(k % 6 == i, x) for i, x in enumerate(shapes)])
    return table(spark, sf, "events").select("event_id", transcripts.parse_tool_call(text).alias("c")).select("event_id", "c.name", "c.arguments")


@query("N03_final_actions", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'search' WHEN 5 THEN 'visit' WHEN 7 THEN '' ELSE 'answer' END AS tool,
  CASE event_id % 8 WHEN 0 THEN replace(props, ' ', '') WHEN 5 THEN concat('{"s":"}{","u":{"id":', user_id, '}}') ELSE '{}' END AS args, event_id % 8 NOT IN (0, 5, 7) AS final,
  CASE WHEN event_id % 8 IN (0, 5, 7) THEN '' WHEN event_id % 8 = 3 THEN concat('u', user_id) ELSE event_type END AS answer FROM events""")
def n03_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Each format of an evaluated reply, and what wins where two of them stand."""
    k, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    shapes = (
        F.concat(F.lit('<tool_call>{"name": "search", "arguments": '), "props", F.lit("}</tool_call> Answer: late")),
        F.concat(F.lit('<tool_call> {"name": "answer", "arguments": {"text": "'), t, F.lit('"}} </tool_call><answer>late</answer>')),
        F.concat(F.lit("<tool_call>{broken</tool_call> <answer> "), t, F.lit(' </answer> answer(text="late")')),
        F.concat(F.lit('so answer(text="u'), u, F.lit('")\nAnswer: late')),
        F.concat(F.lit("I see\nAnswer: "), t, F.lit('  \n{"tool": "late"}')),
        F.concat(F.lit('go {"tool": "visit", "args": {"u": {"id": '), u, F.lit('}, "s": "}{"}} }')),
        F.concat(F.lit('{"tool": "answer", "args": {"text": "'), t, F.lit('"}}')),
        F.concat(F.lit('{"tool": "'), t),
    )
    text = F.coalesce(*[F.when(k % 8 == i, x) for i, x in enumerate(shapes)])
    return table(spark, sf, "events").select("event_id", calls.action_of(text).alias("c")).select("event_id", "c.*")


@query("N03_synthesis_calls", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'look' WHEN 3 THEN 'go' WHEN 4 THEN 'so' WHEN 6 THEN event_type ELSE '' END AS thought,
  CASE event_id % 7 WHEN 0 THEN 'search' WHEN 1 THEN 'answer' WHEN 2 THEN 'crop_and_search' WHEN 3 THEN 'read_entity' WHEN 4 THEN 'answer' END AS tool,
  CASE event_id % 7 WHEN 0 THEN concat('{"query":"', event_type, '"}') WHEN 1 THEN concat('{"text":"', event_type, '"}') WHEN 2 THEN concat('{"bbox":"1, 2","query":"', event_type, '"}')
    WHEN 3 THEN concat('{"entity_id":"Q', user_id, '"}') WHEN 4 THEN concat('{"text":"', user_id, '"}') END AS args FROM events""")
def n03_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each format of a synthesis reply: named calls, keywords, places, answers, and thoughts alone."""
    k, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    shapes = (
        F.concat(F.lit('Thought: look call:default_api:search{"query": "'), t, F.lit('"} answer("late")')),
        F.concat(F.lit('call:answer{"answer": "'), t, F.lit('"}')),
        F.concat(F.lit("Action: crop_and_search(query='first', bbox=[1, 2], query=\""), t, F.lit('")')),
        F.concat(F.lit('go\n```python\nread_entity("Q'), u, F.lit('")\n```')),
        F.concat(F.lit("Reasoning: so answer("), u, F.lit(" )")),
        F.lit("</think> answer( )"),
        F.concat(F.lit("Think: "), t),
    )
    text = F.coalesce(*[F.when(k % 7 == i, x) for i, x in enumerate(shapes)])
    return table(spark, sf, "events").select("event_id", calls.synthesis_call(text).alias("c")).select("event_id", "c.*")


@query("N04_kwargs", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat('it''s \"', event_type, '\"') ELSE NULL END AS q, CASE WHEN event_id % 3 = 2 THEN concat('v', event_id) ELSE event_id::VARCHAR END AS n FROM events")
def n04(spark: SparkSession, sf: str) -> DataFrame:
    """Double quotes, escapes in double and single quotes, bare values, a missing key."""
    k = F.col("event_id")
    shapes = (F.concat(F.lit('find(q="'), "event_type", F.lit('", n='), k, F.lit(")")), F.concat(F.lit("find(n = "), k, F.lit(", q = 'it\\'s \\\""), "event_type", F.lit("\\\"')")), F.concat(F.lit("n=v"), k, F.lit(" and more")))
    text = F.coalesce(*[F.when(k % 3 == i, x) for i, x in enumerate(shapes)])
    return table(spark, sf, "events").select("event_id", transcripts.parse_kwargs(text).alias("m")).select("event_id", F.col("m")["q"].alias("q"), F.col("m")["n"].alias("n"))


@query("N05_first_object", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{"a": "} {", "b": {"c": [', event_id, ', {}]}}') WHEN 2 THEN concat('{"q": "\\"{', event_id, '"}') ELSE '{"never": "closed"}' END AS object FROM events""")
def n05(spark: SparkSession, sf: str) -> DataFrame:
    """An object after a broken one, braces in strings and lists, an escaped quote before a brace, and one inside another that never closes."""
    k = F.col("event_id")
    shapes = (F.concat(F.lit("a {b "), "props", F.lit(' {"later": 1}')), F.concat(F.lit('x {"a": "} {", "b": {"c": ['), k, F.lit(", {}]}} y }")), F.concat(F.lit('{bad} {"q": "\\"{'), k, F.lit('"}')), F.lit('{"open": {"never": "closed"}'))
    text = F.coalesce(*[F.when(k % 4 == i, x) for i, x in enumerate(shapes)])
    return table(spark, sf, "events").select("event_id", transcripts.parse_object(text).alias("object"))


@query("U07_samples", "SELECT p_partkey, k AS sampling_index, concat('<answer>', list_extract(string_split(p_name, ' '), -1), ' ', k, '</answer>') AS reply FROM part, range(4) r(k)")
def u07(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each question and sample."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sampling_index"))
    asked = rows.select("p_partkey", "sampling_index", F.concat_ws(" ", "p_name", "sampling_index").alias("prompt"))
    return providers.complete_column(asked, "prompt", "reply", providers.EchoChat).select("p_partkey", "sampling_index", "reply")


@query("U09_scripted_agent", "SELECT event_type, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'open_result' ELSE 'submit_report' END AS action FROM (SELECT DISTINCT event_type FROM events)")
def u09(spark: SparkSession, sf: str) -> DataFrame:
    script = {"view": "search", "click": "open_result"}
    states = table(spark, sf, "events").select("event_type").distinct()
    return providers.complete_column(states, "event_type", "action", lambda: providers.ScriptedDecision(script))


@query("G03_shortcuts", "SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer)")
def g03b(spark: SparkSession, sf: str) -> DataFrame:
    """Customers from which their nation is one hop away."""
    e = links(spark, sf).where("pid = 'citizen_of'")
    return graph.reachable_within(e.select(F.col("head").alias("sample"), F.col("head").alias("anchor"), F.col("tail").alias("answer")), e, 1).agg(F.count("*").alias("n"))
