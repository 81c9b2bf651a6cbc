"""Questions, skills, rollouts, contracts, probes and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions import match, providers, table_functions, text, transcripts
from trailforge.operators import credit as C
from trailforge.operators import etl, filters, graph, metrics, retrieval, tasks, world
from trailforge.plans import credit
from trailforge.plans import retrieval as plans
from trailforge.plans import text as text_plans
from trailforge.plans.agents import draw, draw_sql
from trailforge.plans.graph import links
from trailforge.plans.registry import query
from trailforge.session import table


def listed(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# questions

HINT_SQL = "coalesce(CASE domain " + " ".join(f"WHEN '{k}' THEN list_extract({listed(v)}, ({draw_sql('p_partkey', repr('h'))} % {len(v)})::INT + 1)" for k, v in text.HINTS.items()) + f" END, '{text.OTHER_HINT}')"
VAGUE_SQL = "coalesce(CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.VAGUE.items()) + f" END, '{text.OTHER_RELATION}')"
CLAUSE_SQL = "CASE direction " + " ".join(f"WHEN '{k}' THEN list_extract({listed(v)}, ({draw_sql('p_partkey', repr('c'))} % {len(v)})::INT + 1)" for k, v in text.CLAUSES.items()) + " END"
DOMAINS, RELATION_NAMES = ("PERSON", "WORK", "ORG", "GEO", "NONE"), (*text.VAGUE, "unheard of")


@query("X20_question_template", f"""SELECT p_partkey, trim(regexp_replace(replace(replace(list_extract({listed(text.QUESTIONS)}, ({draw_sql('p_partkey', repr('q'))} % {len(text.QUESTIONS)})::INT + 1), '{{hint}}', {HINT_SQL}),
  '{{constraint}}', CASE WHEN entity IS NULL THEN '' ELSE replace(replace({CLAUSE_SQL}, '{{entity}}', entity), '{{relation}}', {VAGUE_SQL}) END), '\\s+', ' ', 'g')) AS question
FROM (SELECT p_partkey, list_extract({listed(DOMAINS)}, (p_partkey % {len(DOMAINS)})::INT + 1) AS domain, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS entity, list_extract({listed(RELATION_NAMES)}, (p_partkey % {len(RELATION_NAMES)})::INT + 1) AS relation, CASE WHEN p_size % 2 = 0 THEN 'out' ELSE 'in' END AS direction FROM part)""")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a hint, a vague relation and a clause by direction; some have no constraint."""
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    draws = (draw("p_partkey", F.lit("q")), draw("p_partkey", F.lit("h")), draw("p_partkey", F.lit("c")))
    asked = text.question_text(pick(DOMAINS), F.when(k % 9 > 0, F.col("p_name")), pick(RELATION_NAMES), F.when(F.col("p_size") % 2 == 0, "out").otherwise("in"), draws)
    return table(spark, sf, "part").select("p_partkey", asked.alias("question"))


REWRITES = ("concat('\"Which maker built the person near ', p_brand, '?\"')", "concat('What image shows ', p_name, ' and The City?')", "concat('Who owns the film ', p_type, ' in this image')", "concat('''', p_name, ' or ', p_brand, '''')")
_said = "x"
for _w in text.TYPE_WORDS:
    _said = f"CASE WHEN contains(lower({_said}), '{_w}') THEN replace(replace({_said}, '{_w}', 'the subject'), '{_w.title()}', 'The subject') ELSE {_said} END" if _w in ("the person", "the film", "the city") else _said
_bare = "trim(trim(trim({0}), '\"'), '''')"


@query("X21_rewrite_sanity", f"""WITH r AS (SELECT p_partkey, p_name, CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(REWRITES))} END AS a, CASE (p_partkey + 1) % 4 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(REWRITES))} END AS b FROM part),
s AS (SELECT p_partkey, CASE WHEN NOT contains(lower(a), lower(p_name)) THEN {_bare.format('a')} WHEN NOT contains(lower(b), lower(p_name)) THEN {_bare.format('b')} END AS said FROM r),
i AS (SELECT p_partkey, CASE WHEN contains(lower(said), 'image') THEN said ELSE '{text.IMAGE_LEAD}' || said END AS x FROM s) SELECT p_partkey, {_said} AS question FROM i""")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    """Two tries of a rewriter, checked: the answer is not given away, an image is spoken of, types are neutral."""
    k, name = F.col("p_partkey"), F.col("p_name")
    said = (F.concat(F.lit('"Which maker built the person near '), "p_brand", F.lit('?"')), F.concat(F.lit("What image shows "), name, F.lit(" and The City?")), F.concat(F.lit("Who owns the film "), "p_type", F.lit(" in this image")), F.concat(F.lit("'"), name, F.lit(" or "), "p_brand", F.lit("'")))
    pick = lambda n: F.coalesce(*[F.when(n % 4 == i, v) for i, v in enumerate(said)])
    return table(spark, sf, "part").select("p_partkey", text.sane_rewrite(pick(k), pick(k + 1), name).alias("question"))


@query("X24_remap_path", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('/now/p', page_id, '.png') WHEN 1 THEN concat('/now/shots/p', page_id, '.png') WHEN 2 THEN concat('/now/a/p', page_id, '.png') WHEN 3 THEN concat('/old/gone/p', page_id, '.png') ELSE concat('C:\\project\\a\\p', page_id, '.png') END AS resolved FROM pages")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that are present, that lie under another root by a prefix or by a marker, that are gone, that another system wrote."""
    k, name = F.col("page_id"), F.concat(F.lit("p"), F.col("page_id"), F.lit(".png"))
    slashed = F.concat(F.lit("C:\\project\\a\\"), name)
    path = F.when(k % 5 == 0, F.concat(F.lit("/now/"), name)).when(k % 5 == 1, F.concat(F.lit("/old/shots/"), name)).when(k % 5 == 2, F.concat(F.lit("/mnt/x/project/a/"), name)).when(k % 5 == 3, F.concat(F.lit("/old/gone/"), name)).otherwise(slashed)
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"))
    there = F.when(k % 5 == 0, F.concat(F.lit("/now/"), name)).when(k % 5 == 1, F.concat(F.lit("/now/shots/"), name)).when(k % 5 == 2, F.concat(F.lit("/now/a/"), name))
    present = table(spark, sf, "pages").select(there.alias("path")).where("path IS NOT NULL")
    return etl.remap_paths(rows, present, "path", ("/old/",), ("/project/",), "/now").select("page_id", "resolved")


@query("X26_caption_bridge", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END AS subject, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN '' WHEN 2 THEN p_type ELSE left(repeat(concat(p_name, ' is shown '), 20), 200) END AS description FROM part""")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with both labels, with one, with a label twice, and with none, of which the first 200 characters are kept."""
    k, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    both = F.concat(F.lit("Sure.\n  subject: "), name, F.lit("\nDESCRIPTION:  "), kind, F.lit("\n"))
    twice = F.concat(F.lit("SUBJECT: first\nSubject: "), brand)
    one, none = F.concat(F.lit("description:"), kind), F.repeat(F.concat(name, F.lit(" is shown ")), 20)
    reply = F.when(k % 4 == 0, both).when(k % 4 == 1, twice).when(k % 4 == 2, one).otherwise(none)
    return table(spark, sf, "part").select("p_partkey", text.caption_parts(reply).alias("c")).select("p_partkey", "c.subject", "c.description")


# transcripts and rollouts

TURNS = "t AS (SELECT conv_id, role = 'assistant' AS act, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system')"


N01_SQL = f"""WITH RECURSIVE {TURNS}, s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS step, ''::VARCHAR AS a, ''::VARCHAR AS o FROM conversations
  UNION ALL
  SELECT s.conv_id, t.i, CASE WHEN act AND a <> '' AND o <> '' THEN step + 1 ELSE step END, CASE WHEN act THEN text WHEN act AND o <> '' THEN '' ELSE a END, CASE WHEN NOT act THEN concat(text, ' Q', t.i) WHEN a <> '' AND o <> '' THEN '' ELSE o END FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1
) SELECT conv_id, step, md5(a) AS action, md5(o) AS observation, CASE WHEN o = '' THEN '' ELSE regexp_extract(o, '(Q\\d+)$', 1) END AS ids FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, step ORDER BY i DESC) = 1"""


def transcript_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, t): conversations written as transcripts with tagged blocks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.coalesce("text", F.lit(""))
    c = table(spark, sf, "conversations")
    turns = c.where("role <> 'system'").withColumn("i", F.row_number().over(w))
    block = F.when(F.col("role") == "assistant", F.concat(F.lit("thought <tool_call>"), said, F.lit("</tool_call>"))).otherwise(F.concat(F.lit("<observation>"), said, F.lit(" Q"), "i", F.lit("</observation> and")))
    whole = turns.select("conv_id", F.struct("i", block.alias("b")).alias("b")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["b"]), "\n").alias("t"))
    return c.select("conv_id").distinct().join(whole, "conv_id", "left")


def step_digests(steps: DataFrame) -> DataFrame:
    last = F.element_at(F.concat(F.array(F.lit("")), F.col("ids")), -1)
    return steps.select("conv_id", "step", F.md5(F.col("action").cast("binary")).alias("action"), F.md5(F.col("observation").cast("binary")).alias("observation"), last.alias("ids"))


@query("N01_parse_steps", N01_SQL)
def n01(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts written from conversations and parsed into steps, with the entities of each observation."""
    rows = transcript_rows(spark, sf)
    return step_digests(rows.select("conv_id", F.explode(transcripts.parse_steps("t")).alias("s")).select("conv_id", "s.*"))


@query("N01_lateral", N01_SQL)
def n01_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps by a table function in a lateral join, from SQL."""
    table_functions.register(spark)
    transcript_rows(spark, sf).createOrReplaceTempView(view := f"transcripts_{uuid.uuid4().hex}")
    return step_digests(spark.sql(f"SELECT v.conv_id, s.* FROM {view} v, LATERAL parse_steps(v.t) s"))


ROLL = "r AS (SELECT user_id, (n // 12)::BIGINT AS episode, (n % 12)::INT AS step, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"


@query("N02_rollout_json", f"""WITH {ROLL} SELECT user_id, episode, concat('Q', user_id % 10, ',Q', user_id % 7, ',Q', user_id % 10) AS gold, count(*)::INT AS steps, sum(CASE WHEN event_id % 3 = 0 THEN 100 ELSE event_id % 50 END)::BIGINT AS tokens, count(*) FILTER (WHERE event_type = 'error')::INT AS errors,
  string_agg(CASE WHEN event_id % 4 = 0 AND event_id % 90 <> 1 THEN array_to_string(list_sort(['Q1', concat('Q', event_id % 90)]), ',') WHEN event_id % 4 = 0 THEN 'Q1' ELSE concat('Q', event_id % 90) END, '|' ORDER BY step) AS retrieved, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS outcome FROM r GROUP BY user_id, episode""")
def n02(spark: SparkSession, sf: str) -> DataFrame:
    """Rollouts as JSON with their question's chain, read into trajectories."""
    e, u = F.col("event_id"), F.col("user_id")
    seen = F.concat(F.lit("[1] thing (ID: Q"), e % 90, F.lit(") not Q77"), F.when(F.col("event_type") == "error", " Error").otherwise(""))
    action = F.when(e % 4 == 0, 'read_entity {"entity_id": "Q1"}').otherwise("search")
    acts = table(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"), seen.alias("seen"), F.when(e % 3 != 0, e % 50).alias("tokens"))
    episodes = world.episodes(acts, "user_id", ["ts", "event_id"])
    steps = F.transform("acts", lambda a: F.struct(a["step"].alias("step_index"), a["action"].alias("action"), a["seen"].alias("raw_observation"), a["tokens"].alias("num_tokens")))
    rollout = F.to_json(F.struct((u % 2 == 0).alias("is_correct"), F.concat(F.lit("q"), u).alias("question_id"), steps.alias("steps")))
    hop = lambda a, b: F.struct(F.concat(F.lit("Q"), a).alias("from_qid"), F.concat(F.lit("Q"), b).alias("to_qid"))
    meta = F.to_json(F.struct(F.array(hop(u % 10, u % 7), hop(u % 7, u % 10)).alias("chain")))
    read = episodes.select("user_id", "episode", tasks.trajectory(rollout, meta).alias("t"))
    t = F.col("t")
    return read.select("user_id", "episode", F.array_join(t["gold"], ",").alias("gold"), F.size(t["steps"]).alias("steps"), t["tokens"].alias("tokens"), F.size(F.filter(t["steps"], lambda s: s["is_error"])).alias("errors"), F.array_join(F.transform(t["steps"], lambda s: F.array_join(s["retrieved"], ",")), "|").alias("retrieved"), t["outcome"].alias("outcome"))


@query("N09_messages", f"""WITH {TURNS}, p AS (SELECT *, (i + 1) // 2 AS pair FROM t), m AS (SELECT conv_id, max(i) AS n, string_agg(CASE WHEN i % 2 = 1 THEN concat('assistant=Thought: ', length(text), chr(10), 'Action: ', text) ELSE concat('user=Observation:', chr(10), text) END, '|' ORDER BY i) AS body FROM p GROUP BY conv_id)
SELECT conv_id, n::INT + 3 AS messages, md5(concat('system=S|user=Image: /i/', conv_id, '.jpg', chr(10), chr(10), 'Question: q', conv_id, '|', body, '|assistant=Thought: Based on my research, I have found the answer.', chr(10), 'Action: answer(text="a', conv_id, '")')) AS whole FROM m WHERE conv_id % 3 <> 0""")
def n09(spark: SparkSession, sf: str) -> DataFrame:
    """Correct trajectories as messages: system, image and question, thoughts with actions and whole observations by turns, the answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", (F.row_number().over(w) - 1).alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.groupBy("conv_id", F.floor(F.col("i") / 2).alias("pair")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("text"))).alias("action"), F.max(F.when(F.col("i") % 2 == 1, F.col("text"))).alias("observation"))
    steps = pairs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pair", F.length("action").cast("string").alias("thought"), "action", "observation"))).alias("steps"))
    c = F.col("conv_id").cast("string")
    messages = tasks.messages(F.lit("S"), F.concat(F.lit("/i/"), c, F.lit(".jpg")), F.concat(F.lit("q"), c), F.col("steps"), F.concat(F.lit("a"), c))
    rows = steps.where("conv_id % 3 <> 0").select("conv_id", messages.alias("m"))
    flat = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return rows.select("conv_id", F.size("m").alias("messages"), F.md5(flat.cast("binary")).alias("whole"))


@query("N17_chat_prompt", """SELECT event_id, concat('Goal g', user_id, chr(10), 'State: ', event_type, chr(10), 'Available actions: search, back') AS prompt, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('/i/', event_id, '.png') END AS image, event_type AS state, 'search|back' AS actions,
  CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE concat('{"action":"', event_type, '","params":{"k":', event_id % 9, '}}') END AS reply, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END AS parts FROM events WHERE event_id % 7 <> 0""")
def n17(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of image and text parts with the chosen action, as a chat record; prompts without text are dropped."""
    k, kind = F.col("event_id"), F.col("event_type")
    part = lambda t, x, image, url: F.struct(F.lit(t).alias("type"), x.alias("text"), image.alias("image"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("/i/"), k, F.lit(".png"))
    said = [part("text", F.concat(F.lit(" Goal g"), "user_id", F.lit(" ")), none, none), part("text", F.concat(F.lit("State: "), kind, F.lit("\nAvailable actions: search, back")), none, none)]
    picture = F.when(k % 3 == 1, part("image", none, path, none)).when(k % 3 == 2, part("image_url", none, none, path))
    content = F.when(k % 7 == 0, F.array_compact(F.array(picture))).otherwise(F.array_compact(F.array(picture, *said)))
    prompt = F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))
    chosen = F.when(k % 5 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{ "action": "'), kind, F.lit('", "params": {"k": '), k % 9, F.lit("} }")))
    record = tasks.chat_record(prompt, chosen)
    rows = table(spark, sf, "events").select("event_id", record.alias("r")).where("r IS NOT NULL")
    return rows.select("event_id", "r.prompt", "r.image", "r.state", F.array_join("r.actions", "|").alias("actions"), "r.reply", F.col("r.parts").alias("parts"))


# skills

SKILL_ROWS = "(VALUES " + ", ".join(f"({k}, '{s}', {w}, {listed(p)}::VARCHAR[])" for k, (s, w, p) in enumerate(tasks.SKILLS)) + ") k(id, skill, weight, needs)"
CHOSEN = f"l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, skill) AS i, skill, weight, needs FROM lineitem JOIN {SKILL_ROWS} ON id = l_partkey % {len(tasks.SKILLS)})"


def chosen_skills(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, skills): the skills of a task in their order, one for each line of an order."""
    names = F.array(*[F.lit(s) for s, _, _ in tasks.SKILLS])
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(names, (F.col("l_partkey") % len(tasks.SKILLS)).cast("int")).alias("skill"))  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "skill"))), lambda x: x["skill"]).alias("skills"))


@query("A20_combo_difficulty", f"WITH {CHOSEN} SELECT l_orderkey, round(0.5::DOUBLE * count(*) + sum(weight::DOUBLE) + sum(0.3::DOUBLE * len(needs)), 6) AS difficulty, round(round(0.5::DOUBLE * count(*) + sum(weight::DOUBLE) + sum(0.3::DOUBLE * len(needs)), 6))::INT // 4 AS band FROM l GROUP BY l_orderkey")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """How hard each combination of skills is: their number, their weights and what they need first."""
    d = tasks.combo_difficulty(F.col("skills"))
    return chosen_skills(spark, sf).select("l_orderkey", F.round(d, 6).alias("difficulty"), F.floor(F.round(F.round(d, 6)).cast("int") / 4).cast("int").alias("band"))


@query("A20_skill_graph", f"""WITH {CHOSEN}, c AS (SELECT l_orderkey, round(round(0.5::DOUBLE * count(*) + sum(weight::DOUBLE) + sum(0.3::DOUBLE * len(needs)), 6))::INT // 4 AS band, count(*) AS n, count(*) FILTER (WHERE len(needs) = 0) AS free, sum(len(needs)) AS needs FROM l GROUP BY l_orderkey)
SELECT band, count(*) AS combos, sum(n)::BIGINT AS skills, sum(free)::BIGINT AS free, sum(needs)::BIGINT AS needs FROM c GROUP BY band""")
def a20_graph(spark: SparkSession, sf: str) -> DataFrame:
    """How hard the combinations are: their number in each band of difficulty, with their skills, those that need nothing, and all needs."""
    rows = chosen_skills(spark, sf).select("skills", F.floor(F.round(F.round(tasks.combo_difficulty(F.col("skills")), 6)).cast("int") / 4).cast("int").alias("band"))
    needs = tasks.needs_of(F.col("skills"))
    counted = rows.select("band", F.size("skills").alias("n"), F.size(F.filter(needs, lambda k: k == 0)).alias("free"), F.aggregate(needs, F.lit(0), lambda s, k: s + k).alias("needs"))
    return counted.groupBy("band").agg(F.count("*").alias("combos"), F.sum("n").alias("skills"), F.sum("free").alias("free"), F.sum("needs").alias("needs"))


@query("N11_prerequisite_order", f"""WITH {CHOSEN}, m AS (SELECT a.l_orderkey, a.i, a.skill, list_filter(any_value(a.needs), lambda n: NOT list_contains(coalesce(list(b.skill) FILTER (WHERE b.skill IS NOT NULL), []::VARCHAR[]), n)) AS missing FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.i < a.i GROUP BY a.l_orderkey, a.i, a.skill),
f AS (SELECT l_orderkey, skill, missing, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS r FROM m WHERE len(missing) > 0)
SELECT o.l_orderkey, f.skill IS NULL AS ok, f.skill, array_to_string(missing, ',') AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f ON f.l_orderkey = o.l_orderkey AND r = 1""")
def n11(spark: SparkSession, sf: str) -> DataFrame:
    """The first skill that comes before what it needs, and what is missing."""
    first = tasks.first_unmet(F.col("skills"))
    return chosen_skills(spark, sf).select("l_orderkey", first.alias("f")).select("l_orderkey", F.col("f").isNull().alias("ok"), "f.skill", F.array_join("f.missing", ",").alias("missing"))


SCRIPTED = "[" + ", ".join(f"{{'s': '{s}', 'a': '{a}'}}" for s, a in tasks.SCRIPT) + "]"


@query("N13_scripted_trajectory", f"WITH {CHOSEN}, s AS (SELECT l_orderkey, list(skill) AS skills FROM l GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_transform(list_filter({SCRIPTED}, lambda x: list_contains(skills, x.s)), lambda x: x.a), '>') AS script FROM s")
def n13(spark: SparkSession, sf: str) -> DataFrame:
    """The actions that a task's skills ask for, in the fixed order of the script."""
    return chosen_skills(spark, sf).select("l_orderkey", F.array_join(tasks.scripted(F.col("skills")), ">").alias("script"))


VISUAL = ("search", "click_product", "zoom", "buy", "back", "memory", "compare", "aggregate")


@query("N15_task_conversion", f"""WITH l AS (SELECT l_orderkey, list(list_extract({listed(VISUAL)}, (l_partkey % 8)::INT + 1) ORDER BY l_linenumber, list_extract({listed(VISUAL)}, (l_partkey % 8)::INT + 1)) AS s FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, list_contains(s, 'zoom') AS z, list_contains(s, 'memory') AS m FROM l)
SELECT l_orderkey, CASE l_orderkey % 5 + 1 WHEN 3 THEN 'medium' WHEN 1 THEN 'easy' WHEN 2 THEN 'easy' ELSE 'hard' END AS difficulty, concat('search', CASE WHEN list_contains(s, 'click_product') THEN '>results>detail' ELSE '' END, CASE WHEN list_contains(s, 'back') AND m THEN '>results>detail' ELSE '' END) AS pages,
  z::INT AS zoom_budget, z::INT + m::INT AS gaps, array_to_string(list_transform(list_filter(s, lambda x: x IN ('search', 'click_product', 'zoom', 'buy')), lambda x: CASE x WHEN 'search' THEN 'search:search' WHEN 'click_product' THEN 'results:click_product' ELSE 'detail:' || x END), '>') AS steps,
  concat_ws(',', CASE WHEN z THEN 'zoom_required' END, CASE WHEN m THEN 'multi_page' END, CASE WHEN list_contains(s, 'compare') THEN 'comparison' END, CASE WHEN list_contains(s, 'aggregate') THEN 'numerical_reasoning' END) AS tags FROM c""")
def n15(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of skills as visual tasks: pages, budgets, wanted steps and tags."""
    names = F.array(*map(F.lit, VISUAL))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(names, (F.col("l_partkey") % 8).cast("int")).alias("skill"))  # noqa: E741
    rows = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "skill"))), lambda x: x["skill"]).alias("skills"))
    t = tasks.visual_task(F.col("skills"), F.col("l_orderkey") % 5 + 1)
    rows = rows.select("l_orderkey", t.alias("t"))
    return rows.select("l_orderkey", "t.difficulty", F.array_join("t.pages", ">").alias("pages"), "t.zoom_budget", "t.gaps", F.array_join(F.transform("t.steps", lambda s: F.concat(s["state"], F.lit(":"), s["action"])), ">").alias("steps"), F.array_join("t.tags", ",").alias("tags"))


# contracts and probes

CONTRACT = """SELECT o_orderkey, o_orderkey % 6 = 0 AS no_goal, (o_orderkey % 4)::INT AS facts, (o_orderkey % 7)::INT AS steps, (o_orderkey % 3)::INT AS cites, (o_orderkey % 5)::INT AS depth, (o_orderkey % 4)::INT - 1 AS gaps, (o_orderkey % 3)::INT AS zooms, (o_orderkey % 6)::INT AS length, (o_orderkey % 2)::INT AS zoom_steps FROM orders"""


@query("F22_contract_errors", f"""SELECT o_orderkey, concat_ws(',', CASE WHEN no_goal THEN 'goal' END, CASE WHEN facts = 0 THEN 'primary_facts' END, CASE WHEN steps < 3 THEN 'max_steps' END, CASE WHEN cites < 1 THEN 'min_citations' END) AS research,
  concat_ws(',', CASE WHEN no_goal THEN 'goal' END, CASE WHEN depth < 1 THEN 'dag_depth' END, CASE WHEN gaps < 0 THEN 'visual_gaps' END, CASE WHEN zooms > gaps THEN 'zoom_budget' END, CASE WHEN length < depth THEN 'trajectory_length' END, CASE WHEN zoom_steps < zooms THEN 'zoom_steps' END) AS visual FROM ({CONTRACT})""")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each task, as a research task and as a visual one."""
    k = F.col("o_orderkey")
    small = lambda n: (k % n).cast("int")
    goal = F.when(k % 6 != 0, "goal").otherwise("")
    research = filters.research_contract(goal, small(4), small(7), small(3))
    visual = filters.visual_contract(goal, small(5), small(4) - 1, small(3), small(6), small(2))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(research, ",").alias("research"), F.array_join(visual, ",").alias("visual"))


PROBES = """probe AS (SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = p_partkey % 100 + 1) THEN 'shortcut' WHEN p_partkey % 5 = 0 THEN 'text_only_solvable' WHEN p_partkey % 11 <> 0 AND p_partkey % 7 = 0 THEN 'vlm_direct_solvable' WHEN p_partkey % 11 <> 0 AND p_partkey % 3 = 0 THEN 'vision_only_solvable' END AS reason FROM part)"""


def probed(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with what each probe would see: the answer's name where a model could tell, else the brand."""
    k, name = F.col("p_partkey"), F.col("p_name")
    tell = lambda n: F.when(k % n == 0, name).otherwise(F.concat(F.lit("by "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", name.alias("answer"), tell(5).alias("text"), F.when(k % 11 != 0, tell(7)).alias("direct"), F.when(k % 11 != 0, tell(3)).alias("vision"), F.concat(F.lit("P"), k).alias("anchor"), F.concat(F.lit("S"), k % 100 + 1).alias("goal"))


@query("F18_probe_order", f"WITH {PROBES} SELECT coalesce(reason, 'passed') AS stage, count(*) AS n FROM probe GROUP BY ALL")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """Shortcut, text alone, image and question, image alone: each stage sees only what the one before let through."""
    rows = probed(spark, sf)
    near = graph.reachable_within(rows.select(F.col("p_partkey").alias("sample"), "anchor", F.col("goal").alias("answer")), links(spark, sf).where("pid = 'supplied_by'"), 1)
    stages = [("text_only_solvable", "text"), ("vlm_direct_solvable", "direct"), ("vision_only_solvable", "vision")]
    return tasks.staged_probes(rows, "p_partkey", near.select(F.col("sample").alias("p_partkey")), stages, providers.EchoChat).groupBy("stage").agg(F.count("*").alias("n"))


@query("F17_model_probe", "SELECT p_partkey, p_partkey % 5 = 0 AS by_text, p_partkey % 11 <> 0 AND p_partkey % 7 = 0 AS direct, p_partkey % 11 <> 0 AND p_partkey % 3 = 0 AS by_vision FROM part")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Three modes of a stand-in model, each alone: whether it is right; without a picture a probe cannot be."""
    rows = probed(spark, sf)
    out = rows.select("p_partkey", "answer", "text", "direct", "vision")
    for column, name in (("text", "by_text"), ("direct", "direct_ok"), ("vision", "by_vision")):
        out = tasks.probe(out, column, "answer", name, providers.EchoChat)
    return out.select("p_partkey", "by_text", F.col("direct_ok").alias("direct"), "by_vision")


# styles

STYLES = """st AS (SELECT p_partkey, md5(p_name) AS a, md5(p_brand) AS b, p_size, p_partkey % 3 = 0 AS nav, p_partkey % 4 <> 0 AS foot, 0.8 + (p_partkey % 7) / 10.0 AS spacing, list_extract(['normal', 'comfortable', 'compact'], (p_partkey % 3)::INT + 1) AS density, (p_partkey % 25) / 100.0 AS shadow FROM part)"""
_hex = lambda c, k: f"('0x' || substring({c}, {k}, 2))::UBIGINT::DOUBLE"
SCORES = f"""{STYLES}, cs AS (SELECT *, (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) AS c, sqrt({' + '.join(f'pow({_hex("a", k)} - {_hex("b", k)}, 2)' for k in (1, 3, 5))}) AS d FROM (SELECT *, {world.LUMINANCE_SQL.format(c='a')} AS la, {world.LUMINANCE_SQL.format(c='b')} AS lb FROM st)),
sc AS (SELECT *, least(1.0::DOUBLE, CASE WHEN c >= 7 THEN 0.4 WHEN c >= 4.5 THEN 0.3 WHEN c >= 3 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN c >= 4.5 THEN 0.2 WHEN c >= 3 THEN 0.1 ELSE 0 END + 0.2 + CASE WHEN p_size BETWEEN 6 AND 24 THEN 0.1 ELSE 0 END + CASE WHEN shadow BETWEEN 0.02 AND 0.15 THEN 0.1 ELSE 0 END) AS readability,
  least(1.0::DOUBLE, CASE WHEN d > 50 AND d < 200 THEN 0.3 WHEN d >= 200 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN nav THEN 0.15 ELSE 0 END + CASE WHEN foot THEN 0.15 ELSE 0 END + CASE WHEN spacing BETWEEN 0.9 AND 1.2 THEN 0.2 ELSE 0 END + CASE WHEN density IN ('normal', 'comfortable') THEN 0.2 ELSE 0 END) AS appeal FROM cs)"""


def styles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    color = lambda c: F.concat(F.lit("#"), F.left(F.md5(F.col(c).cast("binary")), F.lit(6)))
    shown = F.element_at(F.array(*map(F.lit, ("normal", "comfortable", "compact"))), (k % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", color("p_name").alias("primary"), color("p_brand").alias("secondary"), F.lit("Inter").alias("font"), F.col("p_size").alias("radius"), ((k % 25) / F.lit(100.0)).alias("shadow"), (F.lit(0.8) + (k % 7) / F.lit(10.0)).alias("spacing"), shown.alias("density"), (k % 3 == 0).alias("navbar"), (k % 4 != 0).alias("footer"))


def scored_styles(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("primary"), F.col("secondary")
    contrast = world.contrast(a, b)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  computed once, however often it is used
    read = bound(contrast, lambda c: world.readability(c, c, F.col("font"), F.col("radius"), F.col("shadow")))
    far = F.sqrt(sum(F.pow(world.channel(a, k) - world.channel(b, k), F.lit(2)) for k in range(3)))
    like = bound(far, lambda d: world.appeal(d, F.col("navbar"), F.col("footer"), F.col("spacing"), F.col("density")))
    return styles(spark, sf).withColumns({"readability": read, "appeal": like}).withColumn("overall", world.overall(F.col("readability"), F.col("appeal")))


@query("V22_style_score", f"WITH {SCORES} SELECT p_partkey, round(readability, 6) AS readability, round(appeal, 6) AS appeal, round(readability * 0.6 + appeal * 0.4, 6) AS overall FROM sc")
def v22(spark: SparkSession, sf: str) -> DataFrame:
    return scored_styles(spark, sf).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("readability", "appeal", "overall")])


@query("F25_style_gate", f"WITH {SCORES} SELECT p_partkey FROM sc WHERE p_partkey % 10 <> 0 AND p_partkey % 13 <> 0 AND round(readability * 0.6 + appeal * 0.4, 9) >= 0.5")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    """Styles of real pages that have a colour and an overall score of a half."""
    k = F.col("p_partkey")
    page, color = F.when(k % 10 == 0, F.concat(F.lit("synth_"), k)).otherwise(F.concat(F.lit("page_"), k)), F.when(k % 13 != 0, F.col("primary")).otherwise("")
    return scored_styles(spark, sf).where(~page.startswith("synth_") & (color != "") & (F.round("overall", 9) >= 0.5)).select("p_partkey")


@query("A22_library_stats", f"WITH {SCORES}, q AS (SELECT *, round(readability * 0.6 + appeal * 0.4, 9) AS quality FROM sc) SELECT CASE WHEN p_partkey % 10 = 0 THEN 'mixed' ELSE 'real' END AS source, density AS type, count(*) AS n, count(DISTINCT p_size) AS pages, round(avg(quality), 6) AS mean_quality, count(*) FILTER (WHERE quality >= 0.7) AS high FROM q GROUP BY ALL")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """Components and styles by source and type: how many, from how many pages, how good."""
    q = scored_styles(spark, sf).withColumn("quality", F.round("overall", 9))
    source = F.when(F.col("p_partkey") % 10 == 0, "mixed").otherwise("real")
    return q.groupBy(source.alias("source"), F.col("density").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("radius").alias("pages"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count_if(F.col("quality") >= 0.7).alias("high"))


_mixed = lambda share: "printf('#%02x%02x%02x', " + ", ".join(f"floor({share}::DOUBLE * {_hex('x.a', k)} + {1 - share}::DOUBLE * {_hex('y.a', k)})::BIGINT" for k in (1, 3, 5)) + ")"


@query("V23_style_blend", f"""WITH {STYLES}, p AS (SELECT x.p_partkey, CASE x.p_partkey % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'color_from_1' ELSE 'layout_from_1' END AS strategy, {_mixed(0.3)} AS mixed, x.a AS xa, y.a AS ya, x.density AS xd, y.density AS yd, x.p_size AS xr, y.p_size AS yr, x.nav AS xn, y.nav AS yn FROM st x JOIN st y ON y.p_partkey = x.p_partkey + 1)
SELECT p_partkey, strategy, CASE strategy WHEN 'balanced' THEN mixed WHEN 'color_from_1' THEN '#' || left(xa, 6) ELSE '#' || left(ya, 6) END AS "primary", CASE strategy WHEN 'balanced' THEN yd WHEN 'color_from_1' THEN yd ELSE xd END AS density,
  round(CASE strategy WHEN 'balanced' THEN xr * 0.3::DOUBLE + yr * 0.7::DOUBLE WHEN 'color_from_1' THEN yr ELSE xr END::DOUBLE, 6) AS radius, CASE strategy WHEN 'balanced' THEN xn OR yn WHEN 'color_from_1' THEN yn ELSE xn END AS navbar FROM p""")
def v23(spark: SparkSession, sf: str) -> DataFrame:
    """Two styles in one: everything mixed, the colours of the first, or the layout of the first."""
    k = F.col("p_partkey")
    s = styles(spark, sf).select("p_partkey", F.struct("primary", "density", F.col("radius").cast("double").alias("radius"), "navbar").alias("x"))
    pairs = s.join(s.select((k - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")
    strategy = F.when(k % 3 == 0, "balanced").when(k % 3 == 1, "color_from_1").otherwise("layout_from_1")
    return pairs.select("p_partkey", strategy.alias("strategy"), world.blend_styles(F.col("x"), F.col("y"), 0.3, strategy).alias("s")).select("p_partkey", "strategy", "s.primary", "s.density", F.round("s.radius", 6).alias("radius"), "s.navbar")


# rewards

ALLOWED = "CASE WHEN step % 6 = 0 THEN []::VARCHAR[] WHEN step % 6 = 1 THEN ['view', 'click', 'error', 'signup', 'purchase'] ELSE ['view', 'click', 'buy'] END"


@query("V16_completion_reward", f"""WITH {credit.BASE}, c AS (SELECT traj, step, CASE WHEN action = 'purchase' AND step % 2 = 0 THEN 'buy' ELSE action END AS said, CASE WHEN retrieved % 3 = 0 THEN action WHEN retrieved % 3 = 1 THEN 'zoom' ELSE 'buy' END AS wanted, retrieved % 11 = 0 AS broken, retrieved % 4 AS k, CASE WHEN retrieved % 5 = 0 THEN NULL ELSE retrieved % 2 END AS want_k, value / 10 AS reference, retrieved % 2 = 0 AS done, {ALLOWED} AS allowed FROM steps),
r AS (SELECT *, said = wanted AS same, (want_k IS NULL AND k = 0) OR (want_k IS NOT NULL AND k = want_k AND k > 0) OR (want_k = 0 AND false) AS fits FROM c)
SELECT traj, step, round(CASE WHEN broken THEN -1.0 WHEN len(allowed) > 0 AND NOT list_contains(allowed, said) THEN -1.2 WHEN same AND fits THEN greatest(-1.5::DOUBLE, least(2.0::DOUBLE, reference))
  ELSE greatest(-1.5::DOUBLE, least(2.0::DOUBLE, -0.1::DOUBLE + CASE WHEN same THEN 0.7 ELSE -0.55 END + CASE WHEN same THEN CASE WHEN fits THEN 0.45 WHEN want_k IS NOT NULL THEN -0.2 ELSE 0.2 END ELSE 0 END + CASE WHEN wanted = 'zoom' THEN CASE WHEN said = 'zoom' THEN 0.1 ELSE -0.08 END ELSE 0 END + CASE WHEN done AND wanted = said AND said = 'buy' THEN 0.8 ELSE 0 END)) END::DOUBLE, 6) AS reward FROM r""")
def v16(spark: SparkSession, sf: str) -> DataFrame:
    """Completions with JSON in words around it: unreadable, not allowed, the wanted action, or part of it."""
    a, n = F.col("action"), F.col("retrieved")
    said = F.when((a == "purchase") & (F.col("step") % 2 == 0), "buy").otherwise(a)
    params = F.when(n % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"k": '), n % 4, F.lit("}")))
    completion = F.when(n % 11 == 0, F.lit("I would {wait")).otherwise(F.concat(F.lit('Do this: {"action": "'), said, F.lit('", "params": '), params, F.lit("} now")))
    wanted = F.when(n % 3 == 0, a).when(n % 3 == 1, "zoom").otherwise("buy")
    want = F.when(n % 5 != 0, F.create_map(F.lit("k"), (n % 2).cast("string"))).otherwise(F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    names = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    allowed = F.when(F.col("step") % 6 == 0, names()).when(F.col("step") % 6 == 1, names("view", "click", "error", "signup", "purchase")).otherwise(names("view", "click", "buy"))
    reward = tasks.completion_reward(completion, wanted, want, F.col("value") / 10, n % 2 == 0, allowed)
    return credit.steps(spark, sf).select("traj", "step", F.round(reward, 6).alias("reward"))


@query("V18_token_advantage", f"""WITH {credit.BASE}, o AS ({credit.OFFSETS.format('steps')}), loose AS (
  SELECT question, traj, pos, hit, (outcome - mean) / (std + 1e-6) AS adv FROM (SELECT *, count(*) OVER w AS members, avg(outcome) OVER w AS mean, coalesce(stddev_samp(outcome) OVER w, 0) AS std FROM hits JOIN trajs USING (question, traj) WHERE traj % 5 <> 0 WINDOW w AS (PARTITION BY question, pos)) WHERE members >= 2 AND std >= 1e-6),
hops AS (SELECT s.traj, step, max_by(adv, row(hit, -pos)) AS hop FROM steps s JOIN loose a ON a.traj = s.traj AND step >= hit GROUP BY ALL)
SELECT o.traj, o.step, start, "end", {credit._sql('adv')} FROM (SELECT traj, step, CASE WHEN traj % 5 = 0 THEN episode ELSE 0.5 * episode + 0.5 * coalesce(hop, 0) END AS adv FROM steps JOIN episode USING (traj) LEFT JOIN hops USING (traj, step)) x JOIN o ON o.traj = x.traj AND o.step = x.step""")
def v18(spark: SparkSession, sf: str) -> DataFrame:
    """Token ranges with the variant of the advantage that has no fatal mask: trajectories without anchors keep the episode's own."""
    s, t = credit.steps(spark, sf), credit.trajectories(spark, sf)
    found = C.token_advantage(s, t, C.first_hits(s, credit.gold(spark)), F.col("traj") % 5 != 0)
    spans = C.token_offsets(s).select("traj", "step", "start", "end")
    return credit._r(spans.join(found.select("traj", "step", "adv"), ["traj", "step"]), "adv")


# reports

TOP100 = f"{plans.BM25}, {plans.TRUTH}, b AS (SELECT qid, coalesce(min(rank), 101) AS rank FROM truth LEFT JOIN (SELECT * FROM bmr WHERE rank <= 100) r USING (qid, doc_id) GROUP BY qid)"


@query("A12_root_cause", f"""WITH {TOP100}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE rank > 100) AS lost, count(*) FILTER (WHERE rank <= 6) AS top6, count(*) FILTER (WHERE rank <= 20) AS top20, count(*) FILTER (WHERE rank <= 50) AS top50, median(rank)::DOUBLE AS mid FROM b)
SELECT total, lost, top6, top20, top50, mid, CASE WHEN total = 0 THEN 'no_samples' WHEN lost >= greatest(1, floor(total * 0.4)) OR total - lost <= total * 0.5 OR mid > 50 THEN 'mismatch' WHEN top50 - top6 >= greatest(2, floor(total * 0.2)) OR (top20 > top6 AND top50 >= total * 0.7) THEN 'top_k_cut' ELSE 'mismatch_likely' END AS cause FROM s""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Why wanted documents are missed, from the ranks among the first hundred."""
    found = plans.truth(spark, sf).join(plans.sparse(spark, sf, 100), ["qid", "doc_id"], "left").groupBy("qid").agg(F.coalesce(F.min("rank"), F.lit(101)).alias("rank"))
    return metrics.root_cause(found)


OUTCOMES = """oc AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'research' ELSE 'standard' END AS type, toxic, quality = 1 AS success, doc_id % 3 <> 0 AS in_candidates, list_extract(['buy', 'add_cart', 'back', 'zoom'], (doc_id % 4)::INT + 1) AS final_action, doc_id % 13 = 0 AS failed, (n_chars % 12)::INT AS steps, n_chars / 100.0::DOUBLE AS reward FROM labels JOIN documents USING (doc_id))"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    action = F.element_at(F.array(*map(F.lit, ("buy", "add_cart", "back", "zoom"))), (k % 4 + 1).cast("int"))
    return d.select("lang", F.when(k % 2 == 0, "research").otherwise("standard").alias("type"), "toxic", (F.col("quality") == 1).alias("success"), (k % 3 != 0).alias("in_candidates"), action.alias("final_action"), (k % 13 == 0).alias("failed"), (F.col("n_chars") % 12).cast("int").alias("steps"), (F.col("n_chars") / 100).alias("reward"))


@query("A14_report_v1", f"""WITH {OUTCOMES} SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS level, count(*) AS n, round(avg(in_candidates::INT), 6) AS recall_l1, round(avg(in_candidates::INT), 6) AS oracle_l2, round(avg(success::INT), 6) AS success_l3, count(*) FILTER (WHERE final_action IN ('buy', 'add_cart')) AS bought, count(*) FILTER (WHERE failed) AS errors, round(avg(steps), 6) AS mean_steps, round(avg(reward), 6) AS mean_reward FROM oc GROUP BY GROUPING SETS ((lang), ())""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    """The shopping world's report: three layers, purchases, errors, steps and reward, over all and by level."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    g = outcomes(spark, sf).cube("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), share("in_candidates").alias("recall_l1"), share("in_candidates").alias("oracle_l2"), share("success").alias("success_l3"), F.count_if(F.col("final_action").isin("buy", "add_cart")).alias("bought"), F.count_if("failed").alias("errors"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.avg("reward"), 6).alias("mean_reward"))
    return g.withColumn("level", F.when(F.col("g") == 1, "all").otherwise(F.col("lang"))).drop("g", "lang")


@query("A15_treatment_delta", f"""WITH {OUTCOMES}, g AS (SELECT CASE WHEN grouping(type) = 0 THEN 'type:' || type WHEN grouping(lang) = 0 THEN 'level:' || lang ELSE 'all' END AS part, toxic, count(*) AS n, avg(success::INT) AS s, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS d, min(reward) AS lo, max(reward) AS hi, avg(steps) AS st FROM oc WHERE NOT failed GROUP BY GROUPING SETS ((type, toxic), (lang, toxic), (toxic)))
SELECT b.part, b.n AS base_n, t.n AS treat_n, round(b.s, 6) AS base_success, round(t.s, 6) AS treat_success, round(b.m, 6) AS base_mean, round(t.m, 6) AS treat_mean, round(t.m - b.m, 6) AS delta, round(b.d, 6) AS base_std, round(t.d, 6) AS treat_std, b.lo AS base_min, t.lo AS treat_min, b.hi AS base_max, t.hi AS treat_max, round(t.st - b.st, 6) AS steps_delta FROM g b JOIN g t ON t.part = b.part AND b.toxic = 0 AND t.toxic = 1""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline and treatment side by side: success, reward with deviation and range, steps; over all, by type and by level."""
    return metrics.treatment_report(outcomes(spark, sf).where("NOT failed"), "toxic", {"type": "type", "level": "lang"})


NPRED = text_plans.NORM.format("p")


@query("A16_accuracy", f"""WITH m AS (SELECT p_partkey, p, {NPRED} = {text_plans.NORM.format('g')} OR {NPRED} = {text_plans.NORM.format('b')} AS em, contains({NPRED}, {text_plans.NORM.format('g')}) OR contains({NPRED}, {text_plans.NORM.format('b')}) AS sub, p_size % 7 AS turns, p_size % 5 AS searches, p_size % 3 AS reads FROM (SELECT p_partkey, p_size, {text_plans.PRED} AS p, p_name AS g, p_brand AS b FROM part))
SELECT count(*) AS total, count(*) FILTER (WHERE p <> '') AS answered, round(avg(em::INT) * 100, 6) AS em, round(avg(sub::INT) * 100, 6) AS sub, round(avg((p <> '')::INT) * 100, 6) AS answer_rate, round(avg(turns), 6) AS turns, round(avg(searches), 6) AS searches, round(avg(reads), 6) AS reads FROM m""")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and substring accuracy of predictions against lists of answers, with turns and calls."""
    said, s = text_plans._prediction(), F.col("p_size")
    ok = match.list_match(said, F.array(F.col("p_name"), F.col("p_brand")))
    rate = lambda c: F.round(F.avg(c.cast("int")) * 100, 6)
    return table(spark, sf, "part").agg(F.count("*").alias("total"), F.count_if(said != "").alias("answered"), rate(ok["em"]).alias("em"), rate(ok["sub"]).alias("sub"), rate(said != "").alias("answer_rate"), *[F.round(F.avg(s % k), 6).alias(n) for n, k in (("turns", 7), ("searches", 5), ("reads", 3))])


FAIL1 = "CASE WHEN quality = 1 THEN 'Success' WHEN doc_id % 11 = 0 OR doc_id % 17 = 0 THEN 'FormatOrActionError' WHEN doc_id % 7 = 0 THEN 'NeverClickedGT_NotInCandidates' WHEN doc_id % 5 = 0 THEN 'NeverClickedGT' WHEN doc_id % 4 < 2 THEN 'ClickedGTButFinalWrong' WHEN doc_id % 3 = 0 THEN 'PossibleNeedsZoomOrCrop' ELSE 'NeedsManualReview_AfterZoom' END"


@query("V28_failure_buckets_v1", f"SELECT {FAIL1} AS bucket, count(*) AS n FROM labels GROUP BY ALL")
def v28_v1(spark: SparkSession, sf: str) -> DataFrame:
    """The shopping world's failures by the first thing that went wrong."""
    d = F.col("doc_id")
    bucket = metrics.shopping_failure(F.col("quality") == 1, (d % 11 == 0) | (d % 17 == 0), d % 7 != 0, d % 5 != 0, d % 4 < 2, d % 3 != 0)
    return table(spark, sf, "labels").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


#: How many rows each path asks of a list for every row that it returns.
FANOUT = {"engine": 2, "vector_store": 1, "reduced_corpus": 3, "other": 2}


@query("T06_fanout", f"""WITH {plans.BM25}, {plans.VEC}, f(path, fanout) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in FANOUT.items())}),
c AS (SELECT path, qid, doc_id FROM f JOIN dr ON path IN ('engine', 'vector_store') AND rank <= 10 * fanout UNION SELECT path, qid, doc_id FROM f JOIN bmr ON path <> 'vector_store' AND rank <= 10 * fanout)
SELECT path, count(DISTINCT qid) AS queries, count(*) AS candidates FROM c GROUP BY path""")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of ten results by path: each oversamples its lists by its own factor."""
    return retrieval.candidates(plans.lists(spark, sf, 30), 10, FANOUT).groupBy("path").agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("candidates"))
