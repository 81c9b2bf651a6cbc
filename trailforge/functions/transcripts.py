"""Transcript parsing that needs offsets or nested braces: Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks an action and what an observation, as elements or fenced blocks.
_action = re.compile(r"<(?:search|tool_call)>(.*?)</(?:search|tool_call)>|```(?:tool_call|json)\n(.*?)```", re.S)
_observation = re.compile(r"<(?:observation|information|tool_response|results?)>(.*?)</(?:observation|information|tool_response|results?)>|```(?:observation|output|result)\n(.*?)```", re.S)
_entity = re.compile(r"Q\d+")
_pair = re.compile(r"(\w+)\s*=\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^,\s)]+)")
_call = re.compile(r"(\w+)\s*\(([^()]*)\)")


def steps_of(text: str) -> list[dict]:
    """Steps of a transcript (N01): an action begins a new one if the step before has both an action and an observation; within a
    step the last action and the last observation count. A transcript without blocks is one step without either."""
    text = text or ""
    blocks = [(m.start(), m.end(), "action", m) for m in _action.finditer(text)] + [(m.start(), m.end(), "observation", m) for m in _observation.finditer(text)]
    out = [{"step": 0, "action": "", "observation": "", "ids": [], "start": 0, "end": 0}]
    for start, end, kind, m in sorted(blocks, key=lambda b: b[0]):
        step, body = out[-1], next(g for g in m.groups() if g is not None)
        if kind == "action" and step["action"] and step["observation"]:
            out.append(step := {"step": len(out), "action": "", "observation": "", "ids": [], "start": start, "end": 0})
        step[kind] = body
        if kind == "action" and len(out) == 1 and not step["start"]:
            step["start"] = start
        if kind == "observation":
            step["ids"], step["end"] = sorted(set(_entity.findall(body))), end
    out[-1]["end"] = out[-1]["end"] or len(text)
    return out


def first_object(text: str) -> str | None:
    """The first balanced JSON object in a text, strings respected."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        depth, quoted, escaped = 0, False, False
        for k in range(at, len(text)):
            c = text[k]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[at : k + 1])
                        return text[at : k + 1]
                    except ValueError:
                        break
        at = text.find("{", at + 1)
    return None


def keyword_args(text: str) -> dict[str, str]:
    """key=value pairs with quotes and escapes taken off."""
    out = {}
    for key, value in _pair.findall(text or ""):
        if value[:1] in "\"'":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        out[key] = value
    return out


def tool_call(text: str) -> tuple[str | None, str]:
    """(name, arguments as JSON) from a tagged JSON call, a bare JSON object, or name(key=value)."""
    text = text or ""
    tagged = re.search(r"<tool_call>(.*?)</tool_call>", text, re.S)
    found = first_object(tagged.group(1) if tagged else text)
    if found:
        data = json.loads(found)
        name = data.get("name") or data.get("tool") or data.get("action")
        if name:
            return str(name), json.dumps(data.get("arguments") or data.get("args") or data.get("parameters") or {}, sort_keys=True)
    call = _call.search(text)
    return (call.group(1), json.dumps(keyword_args(call.group(2)), sort_keys=True)) if call else (None, "{}")


def parse_steps(column: Column | str) -> Column:
    @F.pandas_udf("array<struct<step:int,action:string,observation:string,ids:array<string>,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(steps_of)

    return run(column)


def parse_tool_call(column: Column | str) -> Column:
    @F.pandas_udf("name string, arguments string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tool_call(t) for t in texts], columns=["name", "arguments"])

    return run(column)


def parse_object(column: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return run(column)


def parse_kwargs(column: Column | str) -> Column:
    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(keyword_args)

    return run(column)
