"""Tool calls and answers in model replies as column expressions: ordered grammars, the first format that fits wins.

JSON is read as a variant, so what is no JSON is null and not an error. An object inside a text is cut by a fold over its
quotes, braces and escapes, so braces may be nested and may stand in strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tools that a synthesis reply may call, and the words that may stand before a thought.
TOOLS = "search|crop_and_search|read_entity|answer"
BEFORE_CALL, BEFORE_THOUGHT = ("Thought:", "Think:", "Reasoning:", "Action:"), ("Thought:", "Think:", "Reasoning:")
#: Patterns of the formats.
FENCE = r"```(?:python|json)?\s*"
NAMED_CALL = rf"(?is)call:(?:\w+:)?({TOOLS})\s*(\{{.*?\}})"
PLAIN_CALL = rf"(?is)\b({TOOLS})\s*\((.*?)\)"
KEYWORD = r"""(?s)(\w+)\s*=\s*(?:"([^"]*?)"|'([^']*?)'|\[([^\]]*?)\])"""
QUOTED = r"""(?s)["'](.+?)["']"""
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
ANSWER_CALL = r"""answer\(text=["'](.+?)["']\)"""
ANSWER_LINE = r"(?m)Answer:\s*(.+?)$"
OLD_CALL = r"""(?s)\{["']tool["']\s*:\s*["']\w+["'].*?\}"""

ACTION = "struct<tool:string,args:string,final:boolean,answer:string>"
CALL = "struct<thought:string,tool:string,args:string>"
NO_ARGUMENTS = "{}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_instr(c, F.lit(pattern)) > 0


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract(c, pattern, k)


def balanced(text: Column) -> Column:
    """The object that a text begins with, up to the brace that closes it; the whole text if none does."""
    return _let(text, _balanced)


def _balanced(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)\\.|\\|["{}]|[^\\"{}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        quoted = F.when(piece == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(s["quoted"], 0).when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        at = s["at"] + F.length(piece)
        closed = (s["end"] == 0) & ~s["quoted"] & (piece == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), F.when(closed, at).otherwise(s["end"]).alias("end"))

    return _let(F.aggregate(pieces, start, step, lambda s: s["end"]), lambda end: F.when(end > 0, F.left(text, end)).otherwise(text))


def _json(text: Column) -> Column:
    """The text as a variant if it is one JSON object, else null."""
    return _let(F.try_parse_json(text), lambda value: F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value))


def _part(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(""))


def _args(value: Column, name: str) -> Column:
    """A part of a variant as JSON with sorted keys; `{}` if it is missing."""
    return F.coalesce(F.to_json(F.try_variant_get(value, f"$.{name}", "variant")), F.lit(NO_ARGUMENTS))


def _action(tool: Column, args: Column, final: Column, answer: Column) -> Column:
    return F.struct(tool.alias("tool"), args.alias("args"), final.alias("final"), answer.alias("answer"))


def _of_json(value: Column, name: str, args: str) -> Column:
    tool = _part(value, name)
    is_answer = tool == "answer"
    text = F.coalesce(F.try_variant_get(value, f"$.{args}.text", "string"), F.lit(""))
    return _action(tool, F.when(is_answer, F.lit(NO_ARGUMENTS)).otherwise(_args(value, args)), is_answer, F.when(is_answer, text).otherwise(F.lit("")))


def action_of(text: Column | str) -> Column:
    """What an evaluated reply does (ACTION): a tagged JSON call, else <answer>, answer(text="..."), an `Answer:` line, or an object with
    a `tool`; a text with none of them has an empty tool."""
    said = lambda c: _action(F.lit("answer"), F.lit(NO_ARGUMENTS), F.lit(True), _stripped(c))

    def old_call(t: Column) -> Column:
        value = _json(balanced(F.substring(t, F.regexp_instr(t, F.lit(OLD_CALL)), F.length(t))))
        nothing = _action(F.lit(""), F.lit(NO_ARGUMENTS), F.lit(False), F.lit(""))
        return F.when(_found(t, OLD_CALL), _let(value, lambda v: F.when(v.isNotNull(), _of_json(v, "tool", "args")).otherwise(nothing))).otherwise(nothing)

    def untagged(t: Column) -> Column:
        return (
            F.when(_found(t, ANSWER_TAG), said(_group(t, ANSWER_TAG)))
            .when(_found(t, ANSWER_CALL), said(_group(t, ANSWER_CALL)))
            .when(_found(t, ANSWER_LINE), said(_group(t, ANSWER_LINE)))
            .otherwise(old_call(t))
        )

    def action(t: Column) -> Column:
        body = _stripped(_group(t, r"(?s)<tool_call>(.*?)(?:<tool_call>|</tool_call>|\z)"))
        tagged = F.when(F.contains(t, F.lit("<tool_call>")) & F.contains(t, F.lit("</tool_call>")), _json(body))
        return _let(tagged, lambda v: F.when(v.isNotNull(), _of_json(v, "name", "arguments")).otherwise(untagged(t)))

    return _let(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), action).cast(ACTION)


def _without(word: str) -> Callable[[Column], Column]:
    return lambda o: F.when(F.startswith(F.lower(o), F.lit(word.lower())), _stripped(F.substring(o, F.lit(len(word) + 1), F.length(o)))).otherwise(o)


def _thought(text: Column, words: tuple[str, ...]) -> Column:
    """A text without these words before it, each looked for in turn."""
    out = _stripped(text)
    for word in words:
        out = _let(out, _without(word))
    return out


def _before(text: Column, pattern: str) -> Column:
    return F.left(text, F.regexp_instr(text, F.lit(pattern)) - 1)


def keywords(args: Column) -> Column:
    """key="value", key='value' and key=[value] pairs as a map with sorted keys; of equal keys the last counts."""
    all_of = lambda k: F.regexp_extract_all(args, F.lit(KEYWORD), F.lit(k))
    pairs = F.arrays_zip(all_of(1).alias("k"), all_of(2).alias("a"), all_of(3).alias("b"), all_of(4).alias("c"))
    found = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("i"), F.concat(p["a"], p["b"], p["c"]).alias("v"))))

    def last_of_each(ordered: Column) -> Column:
        last = F.filter(ordered, lambda p, i: (i == 0) | (p["k"] != F.coalesce(F.get(ordered, i - 1)["k"], F.lit(""))))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))

    return _let(found, last_of_each)


def synthesis_call(text: Column | str) -> Column:
    """The thought and the call of a synthesis reply (CALL): `call:api:tool{json}`, else tool(...), each with its rules for answers; a
    reply without a call is all thought, and its tool and arguments are null."""
    call = lambda thought, tool, args: F.struct(thought.alias("thought"), tool.cast("string").alias("tool"), args.cast("string").alias("args"))
    none = F.lit(None)
    answer = lambda thought, said: _let(said, lambda x: F.when(x != "", call(thought, F.lit("answer"), F.to_json(F.create_map(F.lit("text"), x)))).otherwise(call(thought, none, none)))

    def named(t: Column, tool: Column, value: Column) -> Column:
        thought = _thought(_before(t, NAMED_CALL), BEFORE_THOUGHT)
        said = F.when(F.try_variant_get(value, "$.text", "variant").isNotNull(), _part(value, "text")).otherwise(_part(value, "answer"))
        return F.when(tool == "answer", answer(thought, said)).otherwise(call(thought, tool, F.coalesce(F.to_json(value), F.lit(NO_ARGUMENTS))))

    def plain(t: Column, tool: Column, inside: Column) -> Column:
        thought, quoted = _thought(_before(t, PLAIN_CALL), BEFORE_CALL), _group(inside, QUOTED)
        by_place = F.when(quoted == "", F.create_map().cast("map<string,string>")).when(tool == "read_entity", F.create_map(F.lit("entity_id"), quoted)).otherwise(F.create_map(F.lit("query"), quoted))
        args = _let(keywords(inside), lambda pairs: F.to_json(F.when(F.size(pairs) > 0, pairs).otherwise(by_place)))
        return F.when(tool == "answer", answer(thought, F.when(quoted != "", quoted).otherwise(_stripped(inside)))).otherwise(call(thought, tool, args))

    def parsed(t: Column) -> Column:
        first = _let(F.lower(_group(t, NAMED_CALL)), lambda tool: _let(_json(_group(t, NAMED_CALL, 2)), lambda value: named(t, tool, value)))
        second = _let(F.lower(_group(t, PLAIN_CALL)), lambda tool: _let(_group(t, PLAIN_CALL, 2), lambda inside: plain(t, tool, inside)))
        return F.when(_found(t, NAMED_CALL), first).when(_found(t, PLAIN_CALL), second).otherwise(call(_thought(t, BEFORE_THOUGHT), none, none))

    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    clean = _stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "</think>", ""), FENCE, ""), "```", ""))
    return _let(clean, parsed).cast(CALL)
