"""Agents over providers: scripted play in a world, retry control, ReAct and evaluation loops, tool dispatch, pages from parts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.functions import transcripts
from trailforge.operators import world

Tools = dict[str, Callable[[dict], str]]


def chosen(options: Column, draw: Column) -> Column:
    """One of the options by a drawn number, null if there are none."""
    return F.get(options, (draw % F.greatest(F.size(options), F.lit(1))).cast("int"))


def play_research(tasks: DataFrame, choose: Callable[[Column, Column, dict[str, Column]], Column], steps: int) -> DataFrame:
    """tasks with the state after at most `steps` choices in the research world (U10, U13). choose(state, step, columns) names an
    option or is null; tasks have `gold`, the position of the wanted result. An episode is one fold of bounded length."""
    columns = {c: F.col(c) for c in tasks.columns}

    def turn(s: Column, step: Column) -> Column:
        # the choice is bound once, then used
        return F.get(F.transform(F.array(choose(s, step, columns)), lambda o: world.research_step(s, step, o, F.col("gold"))), F.lit(0))

    return tasks.withColumn("state", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), world.research_start(), turn))


def with_script(tasks: DataFrame, level: Column, target: Column, results: Column, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """tasks with `script`: the template of the task's level with the wanted result and two others put in."""
    other = F.when(results > 1, target % results + 1).otherwise(target)
    second = F.when(results > 2, (target + 1) % results + 1).otherwise(other)
    text = lambda c: c.cast("string")
    fill = lambda o: F.replace(F.replace(F.replace(o, F.lit("{t}"), text(target)), F.lit("{o}"), text(other)), F.lit("{p}"), text(second))
    template = F.coalesce(*[F.when(level == k, F.array(*map(F.lit, v))) for k, v in templates.items()])
    return tasks.withColumn("script", F.transform(template, fill))


def script_pages(script: Column) -> Column:
    """(option, state): each step of a script with the page on which it is taken."""
    document = lambda o: F.replace(o, F.lit("open_result_"), F.lit("document_"))

    def page(option: Column, k: Column) -> Column:
        before, earlier = F.get(script, k - 1), F.get(script, k - 2)
        state = F.when(k == 0, "search").when(before.startswith("open_result_"), document(before)).when((before == "cite_source") & earlier.startswith("open_result_"), document(earlier)).otherwise("results")
        return F.struct(option.alias("option"), state.alias("state"))

    return F.transform(script, page)


def aligned_reward(wanted: Column, on_page: Column, action: Column, params_fit: Column, has_params: Column, zoom: Column, eventful: Column, changed: Column, valid: Column) -> Column:
    """The reward of a step that is held against a script's step (V15); wanted is null where the script has ended."""
    same = F.coalesce(action == wanted, F.lit(False))
    fits = same & F.coalesce(params_fit, F.lit(True))
    amount = lambda condition, yes, no=0.0: F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no)
    against = amount(on_page, 0.15, -0.25) + amount(same, 0.7, -0.55) + F.when(fits, 0.45).when(same & has_params, -0.2).otherwise(0.0)
    against += F.when(F.coalesce(zoom, F.lit(False)), amount(action == "zoom", 0.1, -0.08)).otherwise(0.0)
    against += F.when(same & eventful, 0.2).when((action != "zoom") & ~eventful & same, -0.15).otherwise(0.0)
    reward = F.lit(-0.1) + F.when(wanted.isNull(), -0.2).otherwise(against) - amount(~valid, 0.8)
    reward += F.when(action == "buy", amount(changed, 0.35, -0.35)).when(action == "add_cart", amount(changed, 0.2, -0.15)).otherwise(0.0)
    reward += amount(same & action.isin("buy", "add_cart") & changed, 0.8)
    return F.greatest(F.lit(-1.5), F.least(F.lit(2.0), reward))


def controlled(queries: DataFrame, lists: list[tuple[str, DataFrame]], titles: DataFrame, least: int = 3) -> DataFrame:
    """(qid, pos, strategy, n, grade): the attempts that are made for each query, up to the first of grade A.

    lists: strategies in their order with rows (qid, rank, doc_id). F is what has fewer than `least` results or an
    untitled one among the first three.
    """
    rows = None
    for pos, (_, found) in enumerate(lists):
        own = found.select("qid", "rank", "doc_id", F.lit(pos).alias("pos"))
        rows = own if rows is None else rows.unionByName(own)
    known = rows.join(titles, "doc_id", "left").groupBy("qid", "pos").agg(F.count("*").alias("n"), F.bool_or((F.col("rank") <= 3) & (F.coalesce("title", F.lit("")) == "")).alias("blank"))
    plan = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(name).alias("strategy")) for k, (name, _) in enumerate(lists)])
    every = queries.select("qid", F.explode(plan).alias("p")).select("qid", "p.*").join(known, ["qid", "pos"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    graded = every.select("qid", F.struct("pos", "strategy", n.alias("n"), F.when((n < least) | F.coalesce("blank", F.lit(False)), "F").otherwise("A").alias("grade")).alias("a"))
    one = graded.groupBy("qid").agg(F.collect_list("a").alias("all"), F.min(F.when(F.col("a.grade") == "A", F.col("a.pos"))).alias("stop"))
    return one.select("qid", F.explode(F.filter("all", lambda a: a["pos"] <= F.coalesce("stop", F.lit(len(lists))))).alias("a")).select("qid", "a.*")


_final = re.compile(r"Final Answer:\s*(.*)", re.S)
#: At how many steps before the end an agent is told so.
NOTES = {3: "only 3 steps remain", 1: "this is the last step"}


def react(questions: DataFrame, key: str, truth: str, make: Callable[[], object], make_tools: Callable[[], Tools], budget: int) -> DataFrame:
    """(key, steps, ending, answer, correct, log, warned): one loop of thought, action and observation for each question.

    The agent's reply(key, truth, step, messages) may raise, which ends the loop; force(messages) answers where the loop
    has not. Loops run where their rows are, one agent to a partition; memory is that of one question's messages.
    """

    def loop(agent, tools: Tools, k, gold: str) -> tuple:
        messages, log, answer, ending, warned = [gold], [], None, "forced", False
        for step in range(budget):
            try:
                said = agent.reply(k, gold, step, messages).strip()
            except Exception:  # noqa: BLE001  whatever a model's client raises ends the episode
                log.append("failed")
                ending = "failed"
                break
            if final := _final.search(said):
                log.append("final")
                answer, ending = final[1].strip(), "answered"
                break
            name, arguments = transcripts.tool_call(said)
            ok = name in tools
            seen = tools[name](json.loads(arguments)) if ok else "no such tool" if name else "no action found"
            if name and (note := NOTES.get(budget - step - 1)):
                seen, warned = f"{seen}\n[{note}]", True
            log.append(f"{name or 'none'}:{'ok' if ok else 'bad'}")
            messages += [said, f"Observation: {seen}"]
        answer = answer if answer is not None else agent.force(messages)
        low, want = answer.strip().lower(), gold.strip().lower()
        return k, len(log), ending, answer, bool(low) and (low in want or want in low), " ".join(log), warned

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, tools = make(), make_tools()
        for batch in batches:
            yield pd.DataFrame([loop(agent, tools, k, gold) for k, gold in zip(batch[key], batch[truth], strict=True)], columns=["k", "steps", "ending", "answer", "correct", "log", "warned"]).rename(columns={"k": key})

    return questions.select(key, truth).mapInPandas(run, f"`{key}` {questions.schema[key].dataType.simpleString()}, steps int, ending string, answer string, correct boolean, log string, warned boolean")


def evaluate_turns(recorded: DataFrame, key: str, said: str, make_tools: Callable[[], Tools]) -> DataFrame:
    """(key, termination, turns, searches) of recorded assistant turns (U06): an empty one ends the episode as a failed call would,
    a tool call is run, an answer ends it, anything else is a format error; without an answer it ends by its round limit."""

    def loop(tools: Tools, texts: list[str]) -> tuple[str, int, int]:
        turns = searches = 0
        for text in texts:
            if not text:
                break
            text = text.split("<tool_response>")[0]  # what a model makes up itself
            turns += 1
            if "<tool_call>" in text and "</tool_call>" in text:
                name, arguments = transcripts.tool_call(text)
                if name in tools:
                    tools[name](json.loads(arguments))
                    searches += name == "search"
            elif "<answer>" in text and "</answer>" in text:
                return "answer", turns, searches
        return ("round_limit" if turns else "no_output"), turns, searches

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = make_tools()
        for batch in batches:
            yield pd.DataFrame([(k, *loop(tools, list(texts))) for k, texts in zip(batch[key], batch[said], strict=True)], columns=["k", "termination", "turns", "searches"]).rename(columns={"k": key})

    return recorded.select(key, said).mapInPandas(run, f"`{key}` {recorded.schema[key].dataType.simpleString()}, termination string, turns int, searches int")


def dispatch(calls: DataFrame, hits: DataFrame, pages: DataFrame, size: int = 200) -> DataFrame:
    """(call_id, tool, observation, success) of tool calls (call_id, tool, argument), each tool a join.

    hits: (call_id, rank, title) of searches; pages: (argument, content). A crop needs a picture model, which is not at hand.
    """
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda h: F.concat(F.lit("["), h["rank"], F.lit("] "), h["title"])), "; ")
    found = hits.groupBy("call_id").agg(F.count("*").alias("n"), said.alias("said"))
    visited = pages.select(F.col("argument").alias("page"), F.left("content", F.lit(size)).alias("content"))
    rows = calls.join(found, "call_id", "left").join(visited, F.when(calls["tool"] == "visit", calls["argument"]) == F.col("page"), "left")
    tool, none = F.col("tool"), F.col("argument") == ""
    known = tool.isin("search", "visit", "crop_and_search")
    observation = F.when(~known, "Unknown tool").when(none, "Error: empty argument").when(tool == "search", F.coalesce(F.concat(F.col("n"), F.lit(" results: "), F.col("said")), F.lit("No results"))).when(tool == "visit", F.coalesce(F.concat(F.lit("Page: "), F.col("content")), F.lit("Not found"))).otherwise("Unavailable")
    success = known & ~none & (tool != "crop_and_search") & ~((tool == "visit") & F.col("content").isNull())
    return rows.select("call_id", "tool", observation.alias("observation"), success.alias("success"))


def entity_of_path(path: Column) -> Column:
    """The entity id that a picture's path ends with, else the last one in it, else null."""
    named = F.regexp_extract(path, r"(Q\d+)\.\w+$", 1)
    return F.when(named != "", named).otherwise(F.try_element_at(F.regexp_extract_all(path, F.lit(r"(Q\d+)"), 1), F.lit(-1)))


def assemble(slots: DataFrame, parts: DataFrame, page: str, draw: Callable[[], Column]) -> DataFrame:
    """(page, recipe, html) from slots (page, recipe, slot, kind) and parts (page, kind, p_partkey, p_name) (U11): the part of the least
    draw fills a slot, a minimum with map-side combine; a slot without parts leaves a note."""
    offered = slots.join(parts, [page, "kind"], "left").withColumn("draw", draw())
    one = offered.groupBy(page, "recipe", "slot", "kind").agg(F.min(F.when(F.col("p_partkey").isNotNull(), F.struct("draw", "p_partkey", "p_name"))).alias("c"))
    piece = F.coalesce(F.concat(F.lit('<section class="'), "kind", F.lit('">'), "c.p_name", F.lit("</section>")), F.concat(F.lit("<!-- "), "kind", F.lit(" -->")))
    pages = one.groupBy(page, "recipe").agg(F.array_sort(F.collect_list(F.struct("slot", piece.alias("piece")))).alias("s"))
    return pages.select(page, "recipe", F.concat(F.lit('<main class="'), "recipe", F.lit('">'), F.array_join(F.transform("s", lambda x: x["piece"]), ""), F.lit("</main>")).alias("html"))
