"""Graph queries: how often the edges are shuffled, and that the rows stay the same."""

import pytest

from trailforge import session
from trailforge.operators import graph
from trailforge.plans import graph as graph_plans
from trailforge.plans import registry

SF = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def no_broadcasts(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield SF
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_buckets_follow_the_bytes_of_the_tables(spark, no_broadcasts, monkeypatch):
    monkeypatch.setattr(session, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(session, "_built", {})
    rows = graph_plans.edges(spark, no_broadcasts)
    parts = rows.groupBy("head").count().rdd.getNumPartitions()
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and _exchanges(rows.groupBy("head").count()) == 0
    assert rows.exceptAll(graph_plans.links(spark, no_broadcasts).distinct()).isEmpty() and rows.count() == graph_plans.links(spark, no_broadcasts).distinct().count()
    starts = graph_plans.nodes(spark, no_broadcasts).where("kind = 'C' AND has_image").select("qid")
    assert _exchanges(graph.paths(starts, graph_plans.allowed(spark, no_broadcasts), 3)) == 3


def test_edges_are_shuffled_once_to_be_stored(spark, no_broadcasts, monkeypatch):
    plans = {}

    def keep(source, name, rows, key):
        plans[name] = rows(16)
        return spark.createDataFrame([], plans[name].schema)

    monkeypatch.setattr(graph_plans, "built_table", keep)
    graph_plans.edges(spark, no_broadcasts)
    assert _exchanges(plans["edges"]) == 1


def test_fan_out_is_looked_up_for_candidates_only(spark, no_broadcasts):
    starts = graph_plans.nodes(spark, no_broadcasts).where("kind = 'C' AND has_image").select("qid")
    rows = lambda df: sorted((r["walk"], *r["path"], *r["pids"]) for r in df.collect())
    own = graph.walk(starts, graph_plans.allowed(spark, no_broadcasts), 3, "s", graph_plans.fan(spark, no_broadcasts))
    twice = graph.walk(starts.union(starts.limit(3)), graph_plans.allowed(spark, no_broadcasts), 3, "s", graph_plans.fan(spark, no_broadcasts))
    assert rows(own) == rows(graph.walk(starts, graph_plans.with_fan(spark, no_broadcasts), 3, "s")) == rows(twice)


def test_walks_there_and_back_and_siblings_need_few_shuffles(spark, no_broadcasts):
    found = registry.queries()["J05_no_cycles"](spark, no_broadcasts)
    assert _exchanges(found) <= 3
    assert _exchanges(registry.queries()["J07_distinguishing"](spark, no_broadcasts)) == 4
    loops = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "s", "a"), ("a", "r", "a"), ("b", "r", "c"), (None, "r", "a")], "head string, pid string, tail string")
    e = [tuple(r) for r in loops.collect()]
    want = sum(a[2] is not None and a[2] == b[0] and a[0] is not None and b[2] != a[0] and b[2] != a[2] for a in e for b in e)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph_plans, "edges", lambda *_: loops)
        assert registry.queries()["J05_no_cycles"](spark, no_broadcasts).first()["n"] == want


@pytest.mark.parametrize("name", ["F17_model_probe", "F18_probe_order", "G03_shortcuts"])
def test_no_graph_is_stored_for_one_hop_of_one_relation(spark, monkeypatch, name):
    monkeypatch.setattr(session, "_built", {})
    assert registry.queries()[name](spark, SF).count() and not session._built


def test_a_hop_sorts_the_walks_only(spark, no_broadcasts):
    starts = graph_plans.nodes(spark, no_broadcasts).where("kind = 'C' AND has_image").select("qid")
    found = graph.paths(starts, graph_plans.allowed(spark, no_broadcasts), 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 3


def test_distinguishing_needs_no_stored_graph(spark, monkeypatch):
    monkeypatch.setattr(session, "_built", {})
    found = registry.queries()["J07_distinguishing"](spark, SF)
    assert not session._built
    links, kept = graph_plans.links(spark, SF), ["placed", "contains"]
    e = links.where(links["pid"].isin(kept)).distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.distinguishing(e.where("pid = 'placed'"), e.where("pid = 'contains'"), e).collect()))
