"""Worlds, loops and tools: scripted agents act, and states, logs and rewards are held against recursive SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.functions import providers
from trailforge.operators import agents, retrieval, world
from trailforge.operators.etl import hash_number
from trailforge.plans import retrieval as plans
from trailforge.plans.registry import query
from trailforge.session import checkpoint, table

STOCK = {1: 1, 2: 10}


def draw_sql(*parts: str) -> str:
    return "('0x' || left(md5(concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")), 8))::UBIGINT::BIGINT"


def draw(*parts: Column | str) -> Column:
    return hash_number(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


# the shopping world: a user's events are episodes of twelve actions; each event's id says which action and with what

ACTS = f"""acts AS (
  SELECT user_id, (n // 12)::BIGINT AS episode, (n % 12)::INT AS step, list_extract([{', '.join(f"'{a}'" for a in world.SHOP_ACTIONS)}], (event_id % 10)::INT + 1) AS action, (event_id % 3)::INT AS product,
         CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS name, CASE WHEN event_id % 4 < 2 THEN 'color' ELSE 'size' END AS key, event_type AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
)"""
SHOP = f"""{ACTS}, f AS (
  SELECT DISTINCT user_id, episode, 0 AS i, 'search' AS page, 'search' AS family, NULL::INT AS selected, false AS searched, []::INT[] AS cart, NULL::VARCHAR AS modal, NULL::VARCHAR AS dropdown,
         NULL::VARCHAR AS color, NULL::VARCHAR AS size, 1 AS one, 10 AS two, ''::VARCHAR AS did, ''::VARCHAR AS was, ''::VARCHAR AS events FROM acts
  UNION ALL
  SELECT user_id, episode, i + 1, CASE WHEN did = 'search' OR fd THEN 'results' WHEN click THEN concat('detail_', product) WHEN fr THEN 'search' ELSE page END,
         CASE WHEN did = 'search' OR fd THEN 'results' WHEN click THEN 'detail' WHEN fr THEN 'search' ELSE family END,
         CASE WHEN click THEN product WHEN fd THEN NULL ELSE selected END, searched OR did = 'search', CASE WHEN incart THEN list_append(cart, selected) ELSE cart END,
         CASE WHEN did = 'open_modal' THEN name WHEN did = 'close_modal' THEN NULL ELSE modal END,
         CASE WHEN did = 'toggle_dropdown' THEN CASE WHEN dropdown = name THEN NULL ELSE name END ELSE dropdown END,
         CASE WHEN did = 'apply_filter' AND key = 'color' THEN value ELSE color END, CASE WHEN did = 'apply_filter' AND key = 'size' THEN value ELSE size END,
         CASE WHEN buy AND selected = 1 THEN one - 1 ELSE one END, CASE WHEN buy AND selected = 2 THEN two - 1 ELSE two END, did, page,
         CASE WHEN did = 'search' THEN concat('page_navigated:', page, '>results') WHEN click THEN concat('page_navigated:', page, '>detail_', product)
              WHEN did = 'back' THEN concat('page_navigated:', page, '>', CASE WHEN fd THEN 'results' WHEN fr THEN 'search' ELSE page END)
              WHEN buy THEN concat('inventory_changed:', selected, ':', CASE selected WHEN 1 THEN one ELSE two END, ':', CASE selected WHEN 1 THEN one ELSE two END - 1, ' toast_shown:success')
              WHEN incart THEN concat('cart_count_changed:', len(cart) + 1, ' toast_shown:info') WHEN did = 'open_modal' THEN concat('modal_opened:', name) WHEN did = 'close_modal' THEN 'modal_closed'
              WHEN did = 'toggle_dropdown' THEN concat(CASE WHEN dropdown = name THEN 'dropdown_collapsed:' ELSE 'dropdown_expanded:' END, name) WHEN did = 'apply_filter' THEN concat('filter_applied:', key, '=', value) ELSE '' END
  FROM (
    SELECT f.* EXCLUDE (did, was, events), a.action AS did, product, name, key, value, a.action = 'click_product' AND searched AND product IN (1, 2) AS click,
           a.action = 'buy' AND coalesce(CASE selected WHEN 1 THEN one WHEN 2 THEN two END, 0) > 0 AS buy, a.action = 'add_cart' AND selected IS NOT NULL AS incart,
           a.action = 'back' AND family = 'detail' AS fd, a.action = 'back' AND family = 'results' AS fr
    FROM f JOIN acts a ON a.user_id = f.user_id AND a.episode = f.episode AND a.step = f.i)
)"""


def shop(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id")
    acts = e.select("user_id", "ts", "event_id", F.element_at(F.array(*map(F.lit, world.SHOP_ACTIONS)), (k % 10 + 1).cast("int")).alias("action"), (k % 3).cast("int").alias("product"), F.when(k % 2 == 0, "first").otherwise("second").alias("name"), F.when(k % 4 < 2, "color").otherwise("size").alias("key"), F.col("event_type").alias("value"))
    return world.play_shop(world.episodes(acts, "user_id", ["ts", "event_id"]), STOCK)


@query("U01_fsm_fold", f"WITH RECURSIVE {SHOP} SELECT user_id, episode, page, family, selected, array_to_string(cart, ',') AS cart, modal, dropdown, color, size, one, two FROM f QUALIFY row_number() OVER (PARTITION BY user_id, episode ORDER BY i DESC) = 1")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    """The state that each episode of ten kinds of actions leads to."""
    s = shop(spark, sf).select("user_id", "episode", "state.*")
    at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return s.select("user_id", "episode", "page", "family", "selected", F.array_join("cart", ",").alias("cart"), "modal", "dropdown", at("filters", "color").alias("color"), at("filters", "size").alias("size"), at("stock", 1).alias("one"), at("stock", 2).alias("two"))


def shop_log(spark: SparkSession, sf: str) -> DataFrame:
    return shop(spark, sf).select("user_id", "episode", F.explode("state.log").alias("l")).select("user_id", "episode", "l.*")


@query("U01_fsm_events", f"WITH RECURSIVE {SHOP} SELECT user_id, episode, i - 1 AS step, was AS page, did AS action, events FROM f WHERE i > 0")
def u01_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each step's page, action and the events that it caused."""
    return shop_log(spark, sf).withColumn("events", F.array_join("events", " "))


#: The script that shopping episodes are held against: state, action, wanted product, whether to zoom.
SCRIPT = (("search", "search", None, False), ("results", "click_product", 1, False), ("detail_1", "zoom", None, True), ("detail_1", "buy", None, False))
SCRIPT_SQL = "(VALUES " + ", ".join(f"({k}, '{s}', '{a}', {'NULL' if p is None else p}::INT, {str(z).lower()})" for k, (s, a, p, z) in enumerate(SCRIPT)) + ") x(step, state, wanted, target, zoom)"


@query("V15_aligned_reward", f"""WITH RECURSIVE {SHOP}, l AS (SELECT f.user_id, f.episode, i - 1 AS step, was AS page, did AS action, events <> '' AS eventful, contains(events, 'inventory') OR contains(events, 'cart_count') AS changed, product, (i - 1 + f.user_id) % 6 = 0 AS invalid FROM f JOIN acts a ON a.user_id = f.user_id AND a.episode = f.episode AND a.step = f.i - 1 WHERE i > 0),
r AS (SELECT l.*, wanted, x.state = page AS sm, wanted = action AS am, wanted = action AND (target IS NULL OR target = product) AS pm, target, zoom FROM l LEFT JOIN {SCRIPT_SQL} ON x.step = l.step)
SELECT user_id, episode, step, round(greatest(-1.5::DOUBLE, least(2.0::DOUBLE, -0.1::DOUBLE
  + CASE WHEN wanted IS NULL THEN -0.2 ELSE CASE WHEN sm THEN 0.15 ELSE -0.25 END + CASE WHEN am THEN 0.7 ELSE -0.55 END + CASE WHEN pm THEN 0.45 WHEN am AND target IS NOT NULL THEN -0.2 ELSE 0 END
      + CASE WHEN zoom THEN CASE WHEN action = 'zoom' THEN 0.1 ELSE -0.08 END ELSE 0 END + CASE WHEN am AND eventful THEN 0.2 WHEN action <> 'zoom' AND NOT eventful AND am THEN -0.15 ELSE 0 END END
  - CASE WHEN invalid THEN 0.8 ELSE 0 END + CASE WHEN action = 'buy' THEN CASE WHEN changed THEN 0.35 ELSE -0.35 END WHEN action = 'add_cart' THEN CASE WHEN changed THEN 0.2 ELSE -0.15 END ELSE 0 END
  + CASE WHEN coalesce(am, false) AND action IN ('buy', 'add_cart') AND changed THEN 0.8 ELSE 0 END)), 6) AS reward FROM r""")
def v15(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of the shopping log against a script: state, action, parameters, zoom, events, validity and the final purchase."""
    script = spark.createDataFrame([(k, *row) for k, row in enumerate(SCRIPT)], "step int, state string, wanted string, target int, zoom boolean")
    log = shop_log(spark, sf)
    acts = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 3).cast("int").alias("product"))
    asked = world.episodes(acts, "user_id", ["ts", "event_id"]).select("user_id", "episode", F.explode("acts").alias("a")).select("user_id", "episode", F.col("a.step").alias("step"), F.col("a.product").alias("product"))
    rows = log.join(asked, ["user_id", "episode", "step"]).join(F.broadcast(script), "step", "left")
    changed = F.exists("events", lambda e: e.startswith("inventory") | e.startswith("cart_count"))
    invalid = (F.col("step") + F.col("user_id")) % 6 == 0
    reward = agents.aligned_reward(F.col("wanted"), F.col("state") == F.col("page"), F.col("action"), F.col("target").isNull() | (F.col("target") == F.col("product")), F.col("target").isNotNull(), F.col("zoom"), F.size("events") > 0, changed, ~invalid)
    return rows.select("user_id", "episode", "step", F.round(reward, 6).alias("reward"))


# the research world: one task for each benchmark passage, its results from BM25, its choices by hash

TASKS = f"""{plans.BM25}, {plans.TRUTH}, gt AS (SELECT qid, min(doc_id) AS doc_id FROM truth GROUP BY qid),
tasks AS (SELECT item_id AS qid, coalesce(n, 0)::INT AS results, gold::INT AS gold, item_id % 2 = 0 AS picture FROM benchmark
  LEFT JOIN (SELECT qid, count(*) AS n FROM bmr WHERE rank <= 6 GROUP BY qid) r ON r.qid = item_id
  LEFT JOIN (SELECT qid, rank AS gold FROM bmr JOIN gt USING (qid, doc_id) WHERE rank <= 6) g ON g.qid = item_id)"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, results, gold, picture): how many results each task's search has and which of them is the wanted document."""
    found = plans.sparse(spark, sf, 6)
    wanted = plans.truth(spark, sf).groupBy("qid").agg(F.min("doc_id").alias("gold_id"))
    of = found.join(wanted, "qid", "left").groupBy("qid").agg(F.count("*").cast("int").alias("results"), F.max(F.when(F.col("doc_id") == F.col("gold_id"), F.col("rank"))).cast("int").alias("gold"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return items.join(of, "qid", "left").select("qid", F.coalesce("results", F.lit(0)).alias("results"), "gold", (F.col("qid") % 2 == 0).alias("picture"))


def _world_sql(option: str, steps: str) -> str:
    """The research world as recursive rows, one for each step; option gives the choice in state s, steps the rows to play."""
    return f"""w AS (
  SELECT qid, results, gold, picture, 0 AS i, 'FORMULATE' AS phase, 'formulate' AS page, NULL::INT AS opened, []::INT[] AS cited, false AS done, 0.0::DOUBLE AS total, ''::VARCHAR AS was, ''::VARCHAR AS chosen, 0.0::DOUBLE AS reward FROM tasks
  UNION ALL
  SELECT qid, results, gold, picture, i + 1, CASE WHEN looks OR back THEN 'SEARCH' WHEN opens THEN 'BROWSE' WHEN submit THEN 'SYNTHESIZE' ELSE phase END,
         CASE WHEN looks OR back THEN 'results' WHEN opens THEN concat('document_', k) WHEN submit THEN 'report_submitted' ELSE page END,
         CASE WHEN opens THEN k WHEN looks OR back THEN NULL ELSE opened END, CASE WHEN o = 'cite_source' AND opened IS NOT NULL THEN list_append(cited, opened) ELSE cited END, submit, total + r, phase, o, r
  FROM (
    SELECT *, greatest(-2.0::DOUBLE, least(3.0::DOUBLE, -0.02::DOUBLE + CASE WHEN o = 'search' THEN CASE WHEN gold IS NOT NULL THEN 0.15 ELSE 0.05 END WHEN o = 'cite_source' THEN CASE WHEN opened = gold THEN 0.3 ELSE 0.05 END WHEN o = 'refine_query' THEN 0.03
             WHEN opens THEN CASE WHEN k = gold THEN 0.2 ELSE 0 END WHEN submit THEN CASE WHEN coalesce(list_contains(cited, gold), false) THEN 2.0 ELSE 0 END - CASE WHEN len(cited) < 1 THEN 1.0 ELSE 0 END ELSE 0 END)) AS r
    FROM (SELECT *, o IN ('search', 'refine_query') AS looks, o = 'back_to_results' AS back, starts_with(o, 'open_result_') AS opens, o = 'submit_report' AS submit, try_cast(regexp_extract(o, '(\\d+)$', 1) AS INT) AS k
          FROM (SELECT w.*, {option} AS o FROM w {steps} WHERE NOT done) WHERE o IS NOT NULL))
)"""


OPTIONS = """CASE phase WHEN 'FORMULATE' THEN ['search'] WHEN 'SEARCH' THEN list_transform(range(1, results + 1), lambda k: 'open_result_' || k) || ['refine_query'] || CASE WHEN len(cited) >= 1 THEN ['submit_report'] ELSE []::VARCHAR[] END
  WHEN 'BROWSE' THEN ['back_to_results', 'cite_source'] || CASE WHEN picture THEN ['zoom_doc_image'] ELSE []::VARCHAR[] END || CASE WHEN len(cited) >= 1 THEN ['submit_report'] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END"""
CHOICE = f"list_extract({OPTIONS}, ({draw_sql('qid', 'i')} % greatest(len({OPTIONS}), 1))::INT + 1)"


@query("U13_episode_log", f"WITH RECURSIVE {TASKS}, {_world_sql(CHOICE, 'WHERE i < 12').replace('WHERE i < 12 WHERE NOT done', 'WHERE i < 12 AND NOT done')} SELECT qid, i - 1 AS step, was AS phase, chosen AS option, page, len(cited)::INT AS citations, round(reward, 6) AS reward FROM w WHERE i > 0")
def u13(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes of at most twelve steps: options by phase, a scripted choice, the step and its log; a report ends it."""
    played = agents.play_research(tasks(spark, sf), lambda s, step, t: agents.chosen(world.research_options(s["phase"], t["results"], F.size(s["cited"]), t["picture"]), draw("qid", step)), 12)
    return played.select("qid", F.explode("state.log").alias("l")).select("qid", "l.step", "l.phase", "l.option", "l.page", "l.citations", F.round("l.reward", 6).alias("reward"))


#: Scripts of tasks by difficulty; {t} is the wanted result, {o} and {p} are others.
TEMPLATES = {
    "easy": ("search", "open_result_{t}", "cite_source", "submit_report"),
    "medium": ("search", "open_result_{o}", "back_to_results", "open_result_{t}", "cite_source", "submit_report"),
    "hard": ("search", "open_result_{o}", "back_to_results", "refine_query", "open_result_{t}", "cite_source", "back_to_results", "open_result_{p}", "cite_source", "submit_report"),
}
LEVEL_SQL = "CASE qid % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"
SCRIPT_OF = f"""script AS (SELECT qid, level, k AS i, replace(replace(replace(list_extract(t, k + 1), '{{t}}', target::VARCHAR), '{{o}}', other::VARCHAR), '{{p}}', second::VARCHAR) AS option FROM (
  SELECT qid, level, target, CASE WHEN results > 1 THEN target % results + 1 ELSE target END AS other, CASE WHEN results > 2 THEN (target + 1) % results + 1 WHEN results > 1 THEN target % results + 1 ELSE target END AS second,
         CASE level {' '.join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in TEMPLATES.items())} END AS t
  FROM (SELECT qid, results, coalesce(gold, 1) AS target, {LEVEL_SQL} AS level FROM tasks)), range(10) r(k) WHERE k < len(t))"""


def scripted(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with level and script; distractors are the results after the wanted one."""
    t = tasks(spark, sf).withColumn("level", F.when(F.col("qid") % 3 == 0, "easy").when(F.col("qid") % 3 == 1, "medium").otherwise("hard"))
    return agents.with_script(t, F.col("level"), F.coalesce("gold", F.lit(1)), F.col("results"), TEMPLATES)


@query("N14_template_trajectory", f"WITH {TASKS}, {SCRIPT_OF} SELECT qid, level, i::INT AS step, option, CASE WHEN i = 0 THEN 'search' ELSE coalesce(nullif(page, ''), 'results') END AS state FROM (SELECT *, CASE WHEN lag(option) OVER w LIKE 'open_result_%' THEN replace(lag(option) OVER w, 'open_result_', 'document_') WHEN lag(option) OVER w = 'cite_source' THEN replace(lag(option, 2) OVER w, 'open_result_', 'document_') END AS page FROM script WINDOW w AS (PARTITION BY qid ORDER BY i))")
def n14(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted trajectory of each task by difficulty: what is done on which page."""
    rows = scripted(spark, sf).select("qid", "level", F.posexplode(agents.script_pages(F.col("script"))).alias("step", "s"))
    return rows.select("qid", "level", "step", "s.option", "s.state")


@query("U10_replay_rewards", f"WITH RECURSIVE {TASKS}, {SCRIPT_OF}, {_world_sql('s.option', 'JOIN script s ON s.qid = w.qid AND s.i = w.i')} SELECT qid, phase, i AS steps, len(cited)::INT AS citations, round(total, 6) AS total, coalesce(list_contains(cited, gold), false) AS success FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i DESC) = 1")
def u10(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted trajectories played in the world, their rewards added up."""
    played = agents.play_research(scripted(spark, sf), lambda s, step, t: F.get(t["script"], step), 10)
    s = F.col("state")
    return played.select("qid", s["phase"].alias("phase"), F.size(s["log"]).alias("steps"), F.size(s["cited"]).alias("citations"), F.round(s["total"], 6).alias("total"), F.coalesce(F.array_contains(s["cited"], F.col("gold")), F.lit(False)).alias("success"))


@query("F23_state_diff", """SELECT event_id, concat_ws(',', CASE WHEN event = 'results_returned' AND claimed <> 6 THEN 'result_count' END, CASE WHEN event = 'document_opened' AND doc IS DISTINCT FROM opened THEN 'document_open' END, CASE WHEN event = 'evidence_collected' AND claimed > 4 THEN 'citation_id' END,
  CASE WHEN event = 'page_navigated' AND to_page <> page THEN 'page_nav' END, CASE WHEN event = 'report_submitted' AND NOT submitted THEN 'report_submitted' END,
  CASE WHEN (phase = 'FORMULATE' AND page <> 'formulate') OR (phase = 'SEARCH' AND page <> 'results') OR (phase = 'SYNTHESIZE' AND page <> 'report_submitted') OR (phase = 'BROWSE' AND NOT starts_with(page, 'document_')) THEN 'phase_page' END, CASE WHEN hash <> '' AND hash <> 'h1' THEN 'state_hash' END) AS mismatches
FROM (SELECT event_id, list_extract(['results_returned', 'document_opened', 'evidence_collected', 'page_navigated', 'report_submitted'], (event_id % 5)::INT + 1) AS event, (event_id % 7)::INT AS claimed, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 4)::INT END AS doc, 2 AS opened,
  list_extract(['FORMULATE', 'SEARCH', 'BROWSE', 'SYNTHESIZE'], (event_id // 5 % 4)::INT + 1) AS phase, list_extract(['formulate', 'results', 'document_2', 'report_submitted'], (event_id // 20 % 4)::INT + 1) AS page, list_extract(['results', 'document_2', ''], (event_id % 3)::INT + 1) AS to_raw, nullif(list_extract(['results', 'document_2', ''], (event_id % 3)::INT + 1), '') AS to_page,
  event_id % 2 = 0 AS submitted, CASE WHEN event_id % 6 = 0 THEN 'h2' WHEN event_id % 6 = 1 THEN '' ELSE 'h1' END AS hash FROM events)""")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    """Seven consistency rules between a claimed change and the state that it led to."""
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    event = pick(("results_returned", "document_opened", "evidence_collected", "page_navigated", "report_submitted"), k % 5)
    claim = F.struct((k % 7).cast("int").alias("results"), F.when(k % 4 != 0, (k % 4).cast("int")).alias("document"), (k % 7).cast("int").alias("citation"), pick(("results", "document_2", ""), k % 3).alias("page"), F.when(k % 6 == 0, "h2").when(k % 6 == 1, "").otherwise("h1").alias("hash"))
    phase, page = pick(("FORMULATE", "SEARCH", "BROWSE", "SYNTHESIZE"), F.floor(k / 5) % 4), pick(("formulate", "results", "document_2", "report_submitted"), F.floor(k / 20) % 4)
    found = world.mismatches(phase, page, F.lit(2), F.lit(4), F.lit(6), k % 2 == 0, F.lit("h1"), event, claim)
    return table(spark, sf, "events").select("event_id", F.array_join(found, ",").alias("mismatches"))


# retrieval with retries

JUDGED = f"""{plans.LISTS}, sides AS (SELECT qid, count(DISTINCT source) AS n, min(source) AS side FROM lists GROUP BY qid),
fused AS (SELECT qid, doc_id, sum(CASE WHEN n = 2 THEN 1.0::DOUBLE / (60 + rank) ELSE score END) AS score FROM lists JOIN sides USING (qid) GROUP BY ALL),
hy AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused),
found AS (SELECT 0 AS pos, 'text_hybrid' AS strategy, qid, doc_id, rank FROM hy WHERE rank <= 6 UNION ALL SELECT 1, 'relaxed_topk', qid, doc_id, rank FROM hy WHERE rank <= 6 UNION ALL SELECT 2, 'bm25_only', qid, doc_id, rank FROM bmr WHERE rank <= 6),
asked AS (SELECT item_id AS qid FROM benchmark UNION SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0),
judged AS (SELECT a.qid, s.pos, s.strategy, count(f.doc_id) AS n, CASE WHEN count(f.doc_id) < 3 OR bool_or(f.rank <= 3 AND coalesce(title, '') = '' AND f.doc_id IS NOT NULL) THEN 'F' ELSE 'A' END AS grade
  FROM asked a CROSS JOIN (VALUES (0, 'text_hybrid'), (1, 'relaxed_topk'), (2, 'bm25_only')) s(pos, strategy) LEFT JOIN found f ON f.qid = a.qid AND f.pos = s.pos LEFT JOIN art USING (doc_id) GROUP BY ALL),
ran AS (SELECT *, coalesce(bool_or(grade = 'A') OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM judged)"""


#: The relaxed attempt fuses lists of twice the length: what stands low in both comes up, and the first six of that are judged.
WIDE = """lists_w AS (SELECT qid, 'sparse' AS source, rank, doc_id, score FROM bmr WHERE rank <= 40 UNION ALL SELECT qid, 'dense', rank, doc_id, score FROM dr WHERE rank <= 40),
sides_w AS (SELECT qid, count(DISTINCT source) AS n, min(source) AS side FROM lists_w GROUP BY qid),
fused_w AS (SELECT qid, doc_id, sum(CASE WHEN n = 2 THEN 1.0::DOUBLE / (60 + rank) ELSE score END) AS score FROM lists_w JOIN sides_w USING (qid) GROUP BY ALL),
hy_w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused_w)"""
RELAXED = JUDGED.replace("found AS (", f"{WIDE},\nfound AS (").replace("'relaxed_topk', qid, doc_id, rank FROM hy ", "'relaxed_topk', qid, doc_id, rank FROM hy_w ")


def attempts(spark: SparkSession, sf: str, pool: int = 20, relaxed: int = 20) -> DataFrame:
    """(qid, pos, strategy, n, grade) of the attempts that each query's controller makes: it stops at the first grade A. The hybrid
    attempt fuses the first `pool` rows of both lists, the relaxed one the first `relaxed`; six results of each are judged."""
    dense, sparse = (checkpoint(rows) for rows in plans.lists(spark, sf, max(pool, relaxed)))
    hybrid = lambda size: retrieval.hybrid(dense.where(F.col("rank") <= size), sparse.where(F.col("rank") <= size), k=6).select("qid", "rank", "doc_id")
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid")).union(table(spark, sf, "embeddings").where("vec_id % 20 = 0").select("vec_id")).distinct()
    lists = [("text_hybrid", hybrid(pool)), ("relaxed_topk", hybrid(relaxed)), ("bm25_only", sparse.where("rank <= 6").select("qid", "rank", "doc_id"))]
    return agents.controlled(ids, lists, plans._arts(spark, sf).select("doc_id", "title"))


@query("U04_retry_controller", f"WITH {RELAXED} SELECT qid, arg_min(strategy, (CASE grade WHEN 'A' THEN 0 ELSE 1 END) * 1000 + (100 - n) * 10 + pos) AS strategy, min(grade) AS grade, count(*) AS attempts, count(*) > 1 AS retried FROM ran WHERE NOT late GROUP BY qid")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid, then the same of lists twice as long, then BM25 alone; the first of grade A is taken, else the best of all."""
    best = F.min(F.struct("grade", (-F.col("n")).alias("n"), "pos", "strategy"))
    return attempts(spark, sf, relaxed=40).groupBy("qid").agg(best["strategy"].alias("strategy"), F.min("grade").alias("grade"), F.count("*").alias("attempts"), (F.count("*") > 1).alias("retried"))


@query("A21_controller_metrics", f"WITH {JUDGED}, c AS (SELECT qid, arg_min(strategy, (CASE grade WHEN 'A' THEN 0 ELSE 1 END) * 1000 + (100 - n) * 10 + pos) AS strategy, min(grade) AS grade, count(*) > 1 AS retried, max(n) FILTER (WHERE pos = 0) AS before, arg_min(n, (CASE grade WHEN 'A' THEN 0 ELSE 1 END) * 1000 + (100 - n) * 10 + pos) AS after FROM ran WHERE NOT late GROUP BY qid) SELECT strategy, grade, count(*) AS wins, round(avg(retried::INT), 6) AS retry_rate, round(coalesce(avg(after - before) FILTER (WHERE retried), 0.0), 6) AS improvement FROM c GROUP BY ALL")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    """Wins by strategy and grade, how often a retry was needed and how many results it brought."""
    best = F.min(F.struct("grade", (-F.col("n")).alias("n"), "pos", "strategy"))
    c = attempts(spark, sf).groupBy("qid").agg(best.alias("b"), (F.count("*") > 1).alias("retried"), F.max(F.when(F.col("pos") == 0, F.col("n"))).alias("before"))
    gain = F.when(F.col("retried"), -F.col("b.n") - F.col("before"))
    return c.groupBy(F.col("b.strategy").alias("strategy"), F.col("b.grade").alias("grade")).agg(F.count("*").alias("wins"), F.round(F.avg(F.col("retried").cast("int")), 6).alias("retry_rate"), F.round(F.coalesce(F.avg(gain), F.lit(0.0)), 6).alias("improvement"))


# loops around a model

KIND = f"({draw_sql('p_partkey', 'i')} % 10)"
LOOP = f"""turns AS (SELECT p_partkey, p_name, i, {KIND} AS k FROM part, range(6) r(i)),
cut AS (SELECT p_partkey, min(i) FILTER (WHERE k = 8) AS answered, min(i) FILTER (WHERE k = 9) AS failed FROM turns GROUP BY ALL)"""


@query("U05_react_loop", f"""WITH {LOOP}, e AS (SELECT p_partkey, answered, failed, least(coalesce(answered, 99), coalesce(failed, 99)) AS stop FROM cut)
SELECT p_partkey, least(stop + 1, 6)::INT AS steps, CASE WHEN stop = 99 THEN 'forced' WHEN stop = answered THEN 'answered' ELSE 'failed' END AS ending, CASE WHEN stop < 99 AND stop = answered THEN p_name ELSE concat('forced ', least(stop, 6)) END AS answer, coalesce(stop < 99 AND stop = answered, false) AS correct,
  (SELECT string_agg(CASE WHEN i = stop THEN CASE WHEN k = 8 THEN 'final' ELSE 'failed' END WHEN k < 4 THEN 'search:ok' WHEN k < 6 THEN 'visit:ok' WHEN k = 6 THEN 'fly:bad' ELSE 'none:bad' END, ' ' ORDER BY i) FROM turns t WHERE t.p_partkey = e.p_partkey AND i <= stop) AS log,
  coalesce((SELECT bool_or(i IN (2, 4)) FROM turns t WHERE t.p_partkey = e.p_partkey AND i < stop AND k <= 6), false) AS warned
FROM e JOIN part USING (p_partkey)""")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    """A budget of six steps: thoughts, tool calls, observations, a note when three are left, and a forced answer at the end."""
    asked = table(spark, sf, "part").select("p_partkey", "p_name")
    return agents.react(asked, "p_partkey", "p_name", lambda: providers.DiceAgent(), providers.small_tools, 6)


@query("U06_termination", """WITH c AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'user'),
k AS (SELECT conv_id, r - 1 AS i, CASE WHEN length(coalesce(text, '')) = 0 THEN 'error' WHEN length(text) % 3 = 0 THEN 'answer' WHEN length(text) % 3 = 1 THEN 'search' ELSE 'format' END AS kind FROM c WHERE r <= 4),
s AS (SELECT conv_id, least(coalesce(min(i) FILTER (WHERE kind = 'answer'), 99), coalesce(min(i) FILTER (WHERE kind = 'error'), 99)) AS stop, min(i) FILTER (WHERE kind = 'answer') AS a, count(*) AS n FROM k GROUP BY conv_id)
SELECT conv_id, CASE WHEN stop < 99 AND stop = a THEN 'answer' WHEN stop = 0 THEN 'no_output' ELSE 'round_limit' END AS termination, (CASE WHEN stop = 99 THEN n WHEN stop = a THEN stop + 1 ELSE stop END)::INT AS turns,
  (count(*) FILTER (WHERE kind = 'search' AND i < stop))::INT AS searches FROM s JOIN k USING (conv_id) GROUP BY conv_id, stop, a, n""")
def u06(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded assistant turns replayed through the evaluation loop: tool calls, answers, format errors, and why it ended."""
    c = table(spark, sf, "conversations").where("role <> 'user'")
    n = F.length(F.coalesce("text", F.lit("")))
    said = F.when(n == 0, "").when(n % 3 == 0, "<answer>done</answer>").when(n % 3 == 1, '<tool_call>{"name": "search", "arguments": {"query": "x"}}</tool_call><tool_response>made up').otherwise("thinking aloud")
    turns = world.episodes(c.select("conv_id", "turn", said.alias("said")), "conv_id", ["turn"], 4).where("episode = 0")
    return agents.evaluate_turns(turns.select("conv_id", F.transform("acts", lambda a: a["said"]).alias("said")), "conv_id", "said", providers.small_tools)


@query("U08_tool_dispatch", f"""WITH {plans.BM25}, calls AS (SELECT item_id AS call_id, list_extract(['search', 'visit', 'crop_and_search', 'teleport'], (item_id % 4)::INT + 1) AS tool, CASE WHEN item_id % 8 = 0 THEN '' WHEN item_id % 4 = 1 THEN concat('Q', item_id) ELSE 'x' END AS argument FROM benchmark),
hits AS (SELECT qid, count(*) AS n, string_agg(concat('[', rank, '] ', title), '; ' ORDER BY rank) AS said FROM bmr JOIN art USING (doc_id) WHERE rank <= 3 GROUP BY qid)
SELECT call_id, tool, CASE WHEN tool = 'teleport' THEN 'Unknown tool' WHEN argument = '' THEN 'Error: empty argument' WHEN tool = 'search' THEN coalesce(concat(n, ' results: ', said), 'No results') WHEN tool = 'visit' THEN coalesce(concat('Page: ', left(content, 200)), 'Not found') ELSE 'Unavailable' END AS observation,
       NOT (tool = 'teleport' OR argument = '' OR tool = 'crop_and_search' OR (tool = 'visit' AND content IS NULL)) AS success
FROM calls LEFT JOIN hits ON qid = call_id LEFT JOIN art ON tool = 'visit' AND concat('Q', doc_id) = argument""")
def u08(spark: SparkSession, sf: str) -> DataFrame:
    """Calls dealt to their tools: search by BM25, visits by id, one tool that is not at hand and one that nobody knows."""
    k = F.col("item_id")
    calls = table(spark, sf, "benchmark").select(k.alias("call_id"), F.element_at(F.array(*map(F.lit, ("search", "visit", "crop_and_search", "teleport"))), (k % 4 + 1).cast("int")).alias("tool"), F.when(k % 8 == 0, "").when(k % 4 == 1, F.concat(F.lit("Q"), k)).otherwise("x").alias("argument"))
    arts = plans._arts(spark, sf)
    hits = plans.sparse(spark, sf, 3).join(arts.select("doc_id", "title"), "doc_id").select(F.col("qid").alias("call_id"), "rank", "title")
    return agents.dispatch(calls, hits, arts.select(F.concat(F.lit("Q"), "doc_id").alias("argument"), "content"))


@query("U12_kb_tools", f"""WITH {plans.ART}, asked AS (SELECT item_id AS qid, text FROM benchmark), {plans.KB}, hits AS (SELECT qid, rank, doc_id FROM kr WHERE rank <= 5 UNION ALL SELECT qid, 1, doc_id FROM ke),
calls AS (SELECT qid AS call_id, 'search' AS tool, concat('Q', doc_id) AS found FROM hits UNION ALL SELECT item_id, 'lookup', concat('Q', doc_id) FROM benchmark JOIN documents ON doc_id = item_id UNION ALL SELECT item_id, 'crop', concat('Q', doc_id) FROM benchmark JOIN documents ON doc_id = item_id * 2 WHERE item_id % 5 <> 0)
SELECT call_id, tool, found, string_split(coalesce(text, ''), chr(10))[1] AS title FROM calls JOIN documents ON concat('Q', doc_id) = found""")
def u12(spark: SparkSession, sf: str) -> DataFrame:
    """Three tools over one knowledge base: search by titles, lookup by id, and the id in the path of a cropped picture."""
    arts = plans._arts(spark, sf).withColumn("qid", F.concat(F.lit("Q"), "doc_id"))
    k = F.col("item_id")
    b = table(spark, sf, "benchmark")
    path = F.when(k % 5 == 0, F.lit("pictures/unnamed.jpg")).when(k % 5 == 1, F.concat(F.lit("Q1/Q"), k * 2, F.lit("/view"))).otherwise(F.concat(F.lit("pictures/Q9/Q"), k * 2, F.lit(".jpg")))
    search = retrieval.title_search(arts, plans._asked(spark, sf), plans.word_set, 5).select(F.col("qid").alias("call_id"), F.lit("search").alias("tool"), F.concat(F.lit("Q"), "doc_id").alias("found"))
    lookup = b.select(k.alias("call_id"), F.lit("lookup").alias("tool"), F.concat(F.lit("Q"), k).alias("found"))
    crop = b.select(k.alias("call_id"), F.lit("crop").alias("tool"), agents.entity_of_path(path).alias("found")).where("found IS NOT NULL")
    return search.union(lookup).union(crop).join(arts.select(F.col("qid").alias("found"), "title"), "found").select("call_id", "tool", "found", "title")


#: The slots of a page and the kind of component that fills each, by recipe.
RECIPES = {"plain": ("ECONOMY", "STANDARD"), "rich": ("PROMO", "MEDIUM", "LARGE"), "full": ("SMALL", "STANDARD", "PROMO", "ECONOMY")}
SLOTS_SQL = "(VALUES " + ", ".join(f"('{r}', {k}, '{t}')" for r, v in RECIPES.items() for k, t in enumerate(v)) + ") s(recipe, slot, kind)"


@query("U11_page_assembly", f"""WITH c AS (SELECT p_partkey, p_name, string_split(p_type, ' ')[1] AS kind, p_brand FROM part), pages AS (SELECT DISTINCT p_brand, list_extract(['plain', 'rich', 'full'], ({draw_sql('p_brand')} % 3)::INT + 1) AS recipe FROM part),
picked AS (SELECT p.p_brand, p.recipe, slot, s.kind, arg_min(p_name, row({draw_sql('p.p_brand', 'slot', 'p_partkey')}, p_partkey)) AS name FROM pages p JOIN {SLOTS_SQL} USING (recipe) LEFT JOIN c ON c.kind = s.kind AND c.p_brand = p.p_brand GROUP BY ALL)
SELECT p_brand, recipe, concat('<main class="', recipe, '">', string_agg(CASE WHEN name IS NULL THEN concat('<!-- ', kind, ' -->') ELSE concat('<section class="', kind, '">', name, '</section>') END, '' ORDER BY slot), '</main>') AS html FROM picked GROUP BY p_brand, recipe""")
def u11(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by recipe: a component of the wanted kind for each slot, picked by hash; slots without one are left as notes."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", F.split("p_type", " ")[0].alias("kind"), "p_brand")
    slots = spark.createDataFrame([(r, k, t) for r, v in RECIPES.items() for k, t in enumerate(v)], "recipe string, slot int, kind string")
    pages = parts.select("p_brand").distinct().withColumn("recipe", F.element_at(F.array(*map(F.lit, RECIPES)), (draw("p_brand") % 3 + 1).cast("int")))
    return agents.assemble(pages.join(F.broadcast(slots), "recipe"), parts, "p_brand", lambda: draw("p_brand", "slot", "p_partkey"))
