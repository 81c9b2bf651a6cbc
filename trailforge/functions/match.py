"""Six ways to hold an answer against a gold answer; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailforge.functions.text import last_answer, normalize_answer, plain_tokens, text_or_empty


def _either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _bare(column: Column | str) -> Column:
    return F.rtrim(F.trim(F.lower(text_or_empty(column))), F.lit("."))


def probe_match(prediction: Column | str, gold: Column | str) -> Column:
    """Equal or contained either way, or so without articles taken out as substrings."""
    a, b = _bare(prediction), _bare(gold)
    cut = lambda c: F.replace(F.replace(F.replace(c, F.lit("the ")), F.lit("a ")), F.lit("an "))
    return _either_way(a, b) | (F.trim(cut(a)) == F.trim(cut(b)))


def three_matches(prediction: Column | str, gold: Column | str) -> Column:
    """(exact, contained, normalised, correct) with correct the disjunction."""
    a, b = F.trim(F.lower(text_or_empty(prediction))), F.trim(F.lower(text_or_empty(gold)))
    exact, contained, same = a == b, _either_way(a, b), normalize_answer(prediction) == normalize_answer(gold)
    return F.struct(exact.alias("exact"), contained.alias("contained"), same.alias("normalised"), (exact | contained | same).alias("correct"))


def answer_score(response: Column, golds: Column, most_tags: int = 10) -> Column:
    """1 for an exact normalised match of the last answer with a gold one, .5 for a gold one within it, else 0; a quarter
    of that beyond ten answer tags (M03)."""
    said = normalize_answer(last_answer(response))
    base = F.when(F.exists(golds, lambda g: normalize_answer(g) == said), 1.0).when(F.exists(golds, lambda g: F.contains(said, normalize_answer(g))), 0.5).otherwise(0.0)
    base = F.when(last_answer(response).isNull(), 0.0).otherwise(base)
    return F.when(F.regexp_count(response, F.lit("<answer>")) > most_tags, base / 4).otherwise(base)


def overlap_match(prediction: Column | str, gold: Column | str, least: float = 0.7) -> Column:
    """Equal, contained, or a token Jaccard above 0.7; never for an empty side."""
    a, b = F.trim(F.lower(text_or_empty(prediction))), F.trim(F.lower(text_or_empty(gold)))
    s, t = F.array_distinct(plain_tokens(a)), F.array_distinct(plain_tokens(b))
    share = F.try_divide(F.size(F.array_intersect(s, t)), F.size(F.array_union(s, t)))
    return (a != "") & (b != "") & (_either_way(a, b) | (F.coalesce(share, F.lit(0.0)) > least))


def agent_match(prediction: Column | str, gold: Column | str) -> Column:
    """Equal or contained either way; an empty prediction is wrong."""
    a, b = F.trim(F.lower(text_or_empty(prediction))), F.trim(F.lower(text_or_empty(gold)))
    return (a != "") & _either_way(a, b)


def list_match(prediction: Column, golds: Column) -> Column:
    """(em, sub): exact and substring flags over a list of gold answers."""
    said = normalize_answer(prediction)
    return F.struct(F.exists(golds, lambda g: normalize_answer(g) == said).alias("em"), F.exists(golds, lambda g: F.contains(said, normalize_answer(g))).alias("sub"))
