"""Tasks, skills, rollouts and chat records as column expressions, and staged probes by models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.functions import match, providers, text
from trailforge.session import checkpoint

#: Skills with their weights and what each needs before it; the script's order with the action of each skill.
SKILLS = (
    ("search", 1.0, []),
    ("refine_query", 2.0, ["search"]),
    ("open_result", 1.0, ["search"]),
    ("back_to_results", 1.0, []),
    ("zoom", 2.0, []),
    ("scan", 1.5, []),
    ("cite", 2.0, ["open_result"]),
    ("cross_reference", 3.0, ["cite", "memory"]),
    ("compare", 2.5, ["scan"]),
    ("evaluate", 2.0, ["open_result"]),
    ("memory", 3.0, ["back_to_results"]),
    ("submit_report", 1.0, ["cite"]),
)
SCRIPT = (
    ("search", "search"),
    ("scan", "scan_results"),
    ("open_result", "open_result"),
    ("zoom", "zoom"),
    ("evaluate", "evaluate"),
    ("cite", "cite_source"),
    ("back_to_results", "back_to_results"),
    ("memory", "memory_recall"),
    ("refine_query", "refine_query"),
    ("compare", "compare_results"),
    ("cross_reference", "cross_reference"),
    ("submit_report", "submit_report"),
)

ROLLOUT = "is_correct boolean, question_id string, steps array<struct<step_index:int,action:string,raw_observation:string,num_tokens:bigint>>"
CHAIN = "chain array<struct<from_qid:string,to_qid:string>>"
PROMPT = "array<struct<role:string,content:array<struct<type:string,text:string,image:string,image_url:struct<url:string>>>>>"


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _needs(skill: Column) -> Column:
    return F.coalesce(*[F.when(skill == s, _texts(*needs)) for s, _, needs in SKILLS if needs], _texts())


def combo_difficulty(skills: Column) -> Column:
    """Half a point a skill, its weight, and three tenths for each skill that it needs."""
    weight = lambda s: F.coalesce(*[F.when(s == name, w) for name, w, _ in SKILLS], F.lit(0.0))
    return F.aggregate(skills, F.lit(0.0), lambda total, s: total + 0.5 + weight(s) + 0.3 * F.size(_needs(s)))


def needs_of(skills: Column) -> Column:
    """How many skills each skill needs."""
    return F.transform(skills, lambda s: F.size(_needs(s)))


def first_unmet(skills: Column) -> Column:
    """(skill, missing) of the first skill that comes before something it needs, null if there is none."""
    unmet = F.transform(skills, lambda s, k: F.struct(s.alias("skill"), F.filter(_needs(s), lambda n: ~F.array_contains(F.slice(skills, 1, k), n)).alias("missing")))
    return F.get(F.filter(unmet, lambda u: F.size(u["missing"]) > 0), F.lit(0))


def scripted(skills: Column) -> Column:
    """The script's actions that a set of skills asks for."""
    steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a")) for s, a in SCRIPT])
    return F.transform(F.filter(steps, lambda x: F.array_contains(skills, x["s"])), lambda x: x["a"])


def visual_task(skills: Column, level: Column) -> Column:
    """A skill task (level 1 to 5) as a visual task (N15): difficulty, pages, zoom budget, gaps, wanted steps and tags."""
    has = lambda s: F.array_contains(skills, s)
    pages = F.concat(_texts("search"), F.when(has("click_product"), _texts("results", "detail")).otherwise(_texts()), F.when(has("back") & has("memory"), _texts("results", "detail")).otherwise(_texts()))
    zoom = has("zoom").cast("int")
    where = lambda s: F.when(s == "search", "search").when(s == "click_product", "results").otherwise("detail")
    steps = F.transform(F.filter(skills, lambda s: s.isin("search", "click_product", "zoom", "buy")), lambda s: F.struct(where(s).alias("state"), s.alias("action")))
    tags = F.array_compact(F.array(*[F.when(has(s), t) for s, t in (("zoom", "zoom_required"), ("memory", "multi_page"), ("compare", "comparison"), ("aggregate", "numerical_reasoning"))]))
    difficulty = F.when(level <= 2, "easy").when(level == 3, "medium").otherwise("hard")
    return F.struct(difficulty.alias("difficulty"), pages.alias("pages"), zoom.alias("zoom_budget"), (zoom + has("memory").cast("int")).alias("gaps"), steps.alias("steps"), tags.alias("tags"))


def trajectory(rollout: Column, meta: Column) -> Column:
    """A rollout's JSON with its question's (N02): gold chain with repeats, steps with what they retrieved, tokens (100 where a
    step does not say) and outcome."""
    r, chain = F.from_json(rollout, ROLLOUT), F.from_json(meta, CHAIN)["chain"]
    gold = F.concat(F.transform(F.slice(chain, 1, 1), lambda h: h["from_qid"]), F.transform(chain, lambda h: h["to_qid"]))

    def step(s: Column) -> Column:
        read = F.when(F.contains(s["action"], F.lit("read_entity")), F.regexp_extract(s["action"], r'entity_id":\s*"(Q\d+)"', 1))
        found = F.array_sort(F.array_distinct(F.concat(text.labelled_ids(s["raw_observation"]), F.filter(F.array(read), lambda x: x.isNotNull() & (x != "")))))
        return F.struct(s["step_index"].alias("step"), found.alias("retrieved"), text.is_error(s["raw_observation"]).alias("is_error"), F.coalesce(s["num_tokens"], F.lit(100).cast("long")).alias("tokens"))

    steps = F.transform(r["steps"], step)
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s["tokens"])
    return F.struct(r["question_id"].alias("question"), gold.alias("gold"), steps.alias("steps"), total.alias("tokens"), F.when(r["is_correct"], 1.0).otherwise(0.0).alias("outcome"))


def messages(system: Column, image: Column, question: Column, steps: Column, answer: Column) -> Column:
    """A trajectory as messages (role, content) by turns (N09): thought and action, then the whole observation, the answer last.
    steps: (thought, action, observation), a null observation being none."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.concat(F.lit("Image: "), image, F.lit("\n\nQuestion: "), question)
    turn = lambda s: F.array_compact(F.array(say("assistant", F.concat(F.lit("Thought: "), s["thought"], F.lit("\nAction: "), s["action"])), F.when(s["observation"].isNotNull(), say("user", F.concat(F.lit("Observation:\n"), s["observation"])))))
    final = say("assistant", F.concat(F.lit('Thought: Based on my research, I have found the answer.\nAction: answer(text="'), answer, F.lit('")')))
    return F.concat(F.array(say("system", system), say("user", asked)), F.flatten(F.transform(steps, turn)), F.when(answer != "", F.array(final)).otherwise(F.slice(F.array(final), 1, 0)))


def chat_record(prompt: Column, chosen: Column) -> Column:
    """(prompt, image, state, actions, reply, parts) of a prompt in JSON with the chosen action (N17), null where the prompt has no text."""
    parts = F.flatten(F.transform(F.from_json(prompt, PROMPT), lambda m: m["content"]))
    said = F.array_join(F.filter(F.transform(parts, lambda p: F.when(p["type"] == "text", F.trim(p["text"]))), lambda t: t.isNotNull() & (t != "")), "\n")
    pictures = F.filter(F.transform(parts, lambda p: F.coalesce(p["image"], p["image_url"]["url"])), lambda u: u.isNotNull() & (u != ""))
    actions = F.filter(F.transform(F.split(text.state_line(said, "Available actions"), ","), lambda a: F.trim(a)), lambda a: a != "")
    reply = F.coalesce(F.to_json(F.try_parse_json(chosen)), chosen)
    record = F.struct(said.alias("prompt"), F.coalesce(F.try_element_at(pictures, F.lit(-1)), F.lit("")).alias("image"), text.state_line(said, "State").alias("state"), actions.alias("actions"), reply.alias("reply"), F.size(parts).alias("parts"))
    return F.when(said != "", record)


def completion_reward(completion: Column, wanted: Column, wanted_params: Column, reference: Column, done: Column, allowed: Column) -> Column:
    """The reward of one completion (V16): -1 if it holds no JSON, -1.2 if its action is not allowed, the reference reward if it is the
    wanted one with its parameters, else points for what agrees."""
    found = F.regexp_extract(F.trim(completion), r"(?s)(\{.*\})", 1)
    payload = F.from_json(found, "action string, params map<string,string>")
    said, none = F.coalesce(F.trim(payload["action"]), F.lit("")), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, none)))
    same, fits = said == wanted, entries(payload["params"]) == entries(wanted_params)
    clamp = lambda c: F.greatest(F.lit(-1.5), F.least(F.lit(2.0), c))
    points = F.lit(-0.1) + F.when(same, 0.7).otherwise(-0.55) + F.when(same & fits, 0.45).when(same & (F.size(wanted_params) > 0), -0.2).when(same, 0.2).otherwise(0.0)
    points += F.when(wanted == "zoom", F.when(said == "zoom", 0.1).otherwise(-0.08)).otherwise(0.0) + F.when(done & same & (said == "buy"), 0.8).otherwise(0.0)
    unread, barred = F.try_parse_json(found).isNull(), (F.size(allowed) > 0) & ~F.array_contains(allowed, said)
    return F.when(unread, -1.0).when(barred, -1.2).when(same & fits, clamp(reference)).otherwise(clamp(points))


def probe(rows: DataFrame, prompt: str, answer: str, name: str, make: Callable[[], providers.ChatProvider]) -> DataFrame:
    """rows with `name`: whether a model's reply to a prompt column is right; a null prompt is not asked and not right."""
    asked = providers.complete_column(rows.withColumn("__prompt", F.concat(F.lit("Give a short, specific answer. "), F.coalesce(prompt, F.lit("")))), "__prompt", "__reply", make)
    right = F.col(prompt).isNotNull() & match.probe_match(F.coalesce(text.last_answer("__reply"), F.lit("")), F.col(answer))
    return asked.withColumn(name, F.coalesce(right, F.lit(False))).drop("__prompt", "__reply")


def staged_probes(rows: DataFrame, key: str, solved: DataFrame, stages: list[tuple[str, str]], make: Callable[[], providers.ChatProvider]) -> DataFrame:
    """(key, stage): what lets go of each sample, or passed (F18). solved (key) go first, without a model; then each stage asks about what
    is left, once, as its rows are cut off before the next."""
    gone, left = rows.join(solved, key, "left_semi").select(key, F.lit("shortcut").alias("stage")), rows.join(solved, key, "left_anti")
    for reason, prompt in stages:
        judged = checkpoint(probe(left, prompt, "answer", "__right", make))
        gone = gone.union(judged.where("__right").select(key, F.lit(reason).alias("stage")))
        left = judged.where("NOT __right").drop("__right")
    return gone.union(left.select(key, F.lit("passed").alias("stage")))
