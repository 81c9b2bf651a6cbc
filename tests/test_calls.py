"""Formats of tool calls and answers, one row for each rule and each rank between two of them."""

import json

import pytest
from pyspark.sql import functions as F

from trailforge.functions import calls

NONE = ("", "{}", False, "")
ACTIONS = [
    ('<tool_call>{"name": "search", "arguments": {"query": "a } b", "top": {"k": 3}}}</tool_call>', ("search", '{"query":"a } b","top":{"k":3}}', False, "")),
    ('<tool_call>\n{"name": "answer", "arguments": {"text": "Rome"}}\n</tool_call> <answer>Paris</answer>', ("answer", "{}", True, "Rome")),
    ('<tool_call>{"name": "search"}</tool_call>', ("search", "{}", False, "")),
    ('<tool_call>{"arguments": {"x": 1}}</tool_call>', ("", '{"x":1}', False, "")),
    ("<tool_call>{broken</tool_call><answer> Paris \n</answer>", ("answer", "{}", True, "Paris")),
    ('<tool_call>[1, 2]</tool_call> Answer: Oslo', ("answer", "{}", True, "Oslo")),
    ('<tool_call>{"name": "search"} never closed', NONE),
    ('Answer: no <answer>yes</answer>', ("answer", "{}", True, "yes")),
    ('so answer(text="in Bern")\nAnswer: Basel', ("answer", "{}", True, "in Bern")),
    ("so answer(text='it is')", ("answer", "{}", True, "it is")),
    ("I think.\nAnswer:  the Nile \nand more", ("answer", "{}", True, "the Nile")),
    ('{"tool": "search", "args": {"q": {"deep": "}"}}} tail }', ("search", '{"q":{"deep":"}"}}', False, "")),
    ('x {"tool": "answer", "args": {"text": "Lima"}}', ("answer", "{}", True, "Lima")),
    ('{"tool" : "visit", "note": "\\"{"}', ("visit", "{}", False, "")),
    ("{'tool': 'search', 'args': {}}", NONE),
    ('{"tool": "search", "args": {', NONE),
    ("nothing here", NONE),
    ("", NONE),
    (None, NONE),
]
CALLS = [
    ('Thought: look. call:default_api:search{"query": "x"}', ("look.", "search", {"query": "x"})),
    ('call:Read_Entity {"entity_id": "Q1"} search("late")', ("", "read_entity", {"entity_id": "Q1"})),
    ("Think: hm call:search{not json}", ("hm", "search", {})),
    ('done call:api:answer{"text": "42"}', ("done", "answer", {"text": "42"})),
    ('done call:answer{"answer": "43"}', ("done", "answer", {"text": "43"})),
    ("done call:answer{}", ("done", None, None)),
    ('Thought: I see\nAction: search(query="red tower", region=\'left\')', ("I see\nAction:", "search", {"query": "red tower", "region": "left"})),
    ('Action: search("red tower")', ("", "search", {"query": "red tower"})),
    ("go\n```python\ncrop_and_search(bbox=[1, 2, 3, 4], query='it', query='that')\n```", ("go", "crop_and_search", {"bbox": "1, 2, 3, 4", "query": "that"})),
    ('read_entity("Q5")', ("", "read_entity", {"entity_id": "Q5"})),
    ("READ_ENTITY()", ("", "read_entity", {})),
    ('</think> answer(text="the blue one")', ("", "answer", {"text": "the blue one"})),
    ("answer(the blue one )", ("", "answer", {"text": "the blue one"})),
    ("Reasoning: so answer( )", ("so", None, None)),
    ("Thought: Reasoning: only words", ("only words", None, None)),
    ("research(x) is no call", ("research(x) is no call", None, None)),
    (None, ("", None, None)),
]


def test_actions(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ACTIONS)], "k long, text string").select("k", calls.action_of("text").alias("c")).select("k", "c.*").orderBy("k").collect()
    assert [tuple(r)[1:] for r in rows] == [w for _, w in ACTIONS]


def test_calls(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CALLS)], "k long, text string").select("k", calls.synthesis_call("text").alias("c")).select("k", "c.*").orderBy("k").collect()
    assert [(r["thought"], r["tool"], r["args"] and json.loads(r["args"])) for r in rows] == [w for _, w in CALLS]


@pytest.mark.parametrize(("text", "want"), [("{}x", "{}"), ('{"a": "}"} }', '{"a": "}"}'), ('{"a": "\\"}"}}', '{"a": "\\"}"}'), ("{{}", "{{}"), ("{\\", "{\\"), ('{"é😀": {}} {', '{"é😀": {}}')])
def test_balanced(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(calls.balanced(F.col("t"))).first()[0] == want


def test_no_python_workers(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(calls.action_of("t"), calls.synthesis_call("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
