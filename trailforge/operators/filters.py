"""Ordered first-failure rules over question samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long an answer and a question must be, how large a picture.
MIN_ANSWER, MIN_QUESTION, MIN_IMAGE_BYTES = 2, 30, 5000


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; a rule that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])


def rule_reason(samples: DataFrame, edges: DataFrame, nodes: DataFrame, popular: list[str]) -> DataFrame:
    """Samples with `reason`. samples: (sample, question, answer, answer_qid, anchor_qid, num_hops, chain array<string>, image_bytes, constraint_titles).

    Neighbours are tested in both directions, by a semi-join on the pair; chain nodes are looked up one by one and the first bad
    one decides between its two reasons.
    """
    both = edges.select(F.col("head").alias("anchor_qid"), F.col("tail").alias("answer_qid")).union(edges.select(F.col("tail").alias("anchor_qid"), F.col("head").alias("answer_qid"))).distinct()
    near = samples.join(both, ["anchor_qid", "answer_qid"], "left_semi").select("sample", F.lit(True).alias("near"))
    known = nodes.select(F.col("qid").alias("node"), F.when((F.coalesce("title", F.lit("")) == "") & (F.coalesce("summary", F.lit("")) == ""), "no_context_intermediate").alias("bad"), F.lit(True).alias("known"))
    hops = samples.select("sample", F.posexplode("chain").alias("pos", "node")).join(known, "node", "left")
    bad = hops.withColumn("bad", F.when(F.col("known").isNull(), "missing_intermediate").otherwise(F.col("bad"))).where("bad IS NOT NULL").groupBy("sample").agg(F.min_by("bad", "pos").alias("bad"))
    answer, asked = F.lower("answer"), F.lower("question")
    rules = [
        ("answer_leak", F.contains(asked, answer)),
        ("anchor_answer_shortcut", F.col("near") & (F.col("num_hops") > 1)),
        ("popularity_bias", F.col("answer_qid").isin(popular)),
        ("missing_intermediate", F.col("bad") == "missing_intermediate"),
        ("no_context_intermediate", F.col("bad") == "no_context_intermediate"),
        ("no_image", F.col("image_bytes").isNull()),
        ("tiny_image", F.col("image_bytes") < MIN_IMAGE_BYTES),
        ("answer_too_short", F.length("answer") < MIN_ANSWER),
        ("question_too_short", F.length("question") < MIN_QUESTION),
        ("constraint_is_answer", F.exists("constraint_titles", lambda t: F.lower(t) == answer)),
    ]
    return samples.join(near, "sample", "left").join(bad, "sample", "left").withColumn("reason", first_failure(rules)).drop("near", "bad")


def rejections(judged: DataFrame) -> DataFrame:
    """How often each reason stands, passed samples too (F16)."""
    return judged.groupBy(F.coalesce(F.concat(F.lit("rule:"), "reason"), F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"))


def errors(*checks: tuple[str, Column]) -> Column:
    """The names of all checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))


def research_contract(goal: Column, facts: Column, max_steps: Column, citations: Column) -> Column:
    """What a research task lacks."""
    return errors(("goal", goal == ""), ("primary_facts", facts == 0), ("max_steps", max_steps < 3), ("min_citations", citations < 1))


def visual_contract(goal: Column, depth: Column, gaps: Column, zooms: Column, steps: Column, zoom_steps: Column) -> Column:
    """What does not fit together in a visual task (F22): depth, gaps, zoom budget and its trajectory's steps."""
    return errors(("goal", goal == ""), ("dag_depth", depth < 1), ("visual_gaps", gaps < 0), ("zoom_budget", zooms > gaps), ("trajectory_length", steps < depth), ("zoom_steps", zoom_steps < zooms))
