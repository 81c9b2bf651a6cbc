"""Graph queries over the star schema as a typed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.operators import filters, graph
from trailforge.operators.etl import first_of, hash_number
from trailforge.operators.retrieval import bounded
from trailforge.plans.registry import query
from trailforge.session import built, built_table, table

#: Relations of the test graph: id, name, domain, one-to-one, tier.
RELATIONS = (
    ("placed", "placed order", "PERSON", False, "interesting"), ("placed_by", "placed by", "PERSON", True, "interesting"), ("contains", "contains part", "WORK", False, "interesting"),
    ("supplied_by", "supplied by", "ORG", False, "plain"), ("based_in", "based in", "GEO", True, "boring"), ("citizen_of", "citizen of", "GEO", True, "boring"), ("part_of", "part of", "GEO", True, "plain"),
)
#: Nodes with more edges than this are hubs; suppliers, with about 600 at any size of the tables, are none.
HUB = 1000
KINDS = (("R", "region", "r_regionkey", "r_name"), ("N", "nation", "n_nationkey", "n_name"), ("C", "customer", "c_custkey", "c_name"), ("S", "supplier", "s_suppkey", "s_name"), ("P", "part", "p_partkey", "p_name"), ("O", "orders", "o_orderkey", "o_orderpriority"))
LINKS = (
    ("orders", "concat('C', o_custkey)", "placed", "concat('O', o_orderkey)"), ("orders", "concat('O', o_orderkey)", "placed_by", "concat('C', o_custkey)"),
    ("lineitem", "concat('O', l_orderkey)", "contains", "concat('P', l_partkey)"), ("lineitem", "concat('P', l_partkey)", "supplied_by", "concat('S', l_suppkey)"),
    ("supplier", "concat('S', s_suppkey)", "based_in", "concat('N', s_nationkey)"), ("customer", "concat('C', c_custkey)", "citizen_of", "concat('N', c_nationkey)"), ("nation", "concat('N', n_nationkey)", "part_of", "concat('R', n_regionkey)"),
)
BASE = "nodes AS (SELECT *, ('0x' || left(md5(qid), 8))::UBIGINT % 2 = 0 AS has_image FROM (" + " UNION ALL ".join(f"SELECT concat('{k}', {key}) AS qid, '{k}' AS kind, {name} AS title FROM {t}" for k, t, key, name in KINDS) + ")),\nedges AS (" + " UNION ".join(f"SELECT {h} AS head, '{p}' AS pid, {t} AS tail FROM {src}" for src, h, p, t in LINKS) + "),\nrelations(pid, name, domain, is_1to1, tier) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, '{e}')" for a, b, c, d, e in RELATIONS) + """),
deg AS (SELECT qid, sum(o)::BIGINT AS out_deg, (count(*) - sum(o))::BIGINT AS in_deg, count(*) AS degree FROM (SELECT head AS qid, 1 AS o FROM edges UNION ALL SELECT tail, 0 FROM edges) GROUP BY qid),
allowed AS (SELECT e.*, domain, is_1to1, tier FROM edges e JOIN relations USING (pid) WHERE tail NOT IN (SELECT qid FROM deg WHERE degree > """ + f"{HUB}))"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for k, t, key, name in KINDS:
        rows = table(spark, sf, t).select(F.concat(F.lit(k), key).alias("qid"), F.lit(k).alias("kind"), F.col(name).alias("title"))
        out = rows if out is None else out.union(rows)
    return out.withColumn("has_image", hash_number(F.col("qid")) % 2 == 0)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as the tables have them; some repeat."""
    out = None
    for src, h, p, t in LINKS:
        rows = table(spark, sf, src).select(F.expr(h).alias("head"), F.lit(p).alias("pid"), F.expr(t).alias("tail"))
        out = rows if out is None else out.union(rows)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The stored adjacency: edges without repeats, bucketed and sorted by head, built once for a session and its tables."""
    return built_table(links(spark, sf), "edges", lambda buckets: links(spark, sf).repartition(buckets, "head").distinct(), "head")


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "pid string, name string, domain string, is_1to1 boolean, tier string")


def allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed edges, from the stored ones and the stored hubs: a hop shuffles the walks only."""
    e = edges(spark, sf)
    hubs = built(links(spark, sf), "hubs", lambda path: graph.hubs(e, HUB).write.parquet(path))
    return graph.allowed_edges(e, relations(spark), spark.read.schema("tail string").parquet(hubs))


def fan(spark: SparkSession, sf: str) -> DataFrame:
    """The fan-out of nodes over allowed edges, stored by node in the buckets of the edges."""
    return built_table(links(spark, sf), "fan", lambda buckets: graph.fan(allowed(spark, sf)), "tail")


@query("A01_degrees", f"WITH {BASE} SELECT qid, out_deg, in_deg, degree FROM deg")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf))


@query("A02_graph_stats", f"WITH {BASE} SELECT count(*) AS nodes, (sum(coalesce(degree, 0)) / 2)::BIGINT AS edges, round(avg(coalesce(degree, 0)), 6) AS avg_degree, max(degree) AS max_degree, count(*) FILTER (WHERE degree >= 5) AS rich, count(*) FILTER (WHERE has_image) AS with_image FROM nodes LEFT JOIN deg USING (qid)")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(nodes(spark, sf), edges(spark, sf))


@query("G01_build_graph", f"WITH {BASE} SELECT kind, pid, count(*) AS n FROM edges JOIN nodes ON qid = head GROUP BY ALL")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).join(nodes(spark, sf).select(F.col("qid").alias("head"), "kind"), "head").groupBy("kind", "pid").agg(F.count("*").alias("n"))


@query("F09_eligible", f"WITH {BASE} SELECT qid FROM nodes WHERE has_image INTERSECT SELECT qid FROM nodes WHERE title IS NOT NULL")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return n.where("title IS NOT NULL").join(n.where("has_image").select("qid"), "qid", "left_semi").select("qid")


@query("D01_intersection", f"WITH {BASE} SELECT tail AS qid FROM edges WHERE pid = 'based_in' INTERSECT SELECT tail FROM edges WHERE pid = 'citizen_of'")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return e.where("pid = 'based_in'").select(F.col("tail").alias("qid")).intersect(e.where("pid = 'citizen_of'").select("tail"))


@query("D02_difference", f"WITH {BASE} SELECT qid FROM nodes WHERE kind = 'P' EXCEPT SELECT e.tail FROM edges e JOIN edges b ON b.tail = e.head AND b.pid = 'placed' WHERE e.pid = 'contains' AND ('0x' || left(md5(b.head), 8))::UBIGINT % 30 = 0")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that none of a thirtieth of the customers, the blacklisted ones, has ordered."""
    e = edges(spark, sf)
    barred = e.where("pid = 'placed'").where(hash_number(F.col("head")) % 30 == 0).select(F.col("tail").alias("head"))
    used = e.where("pid = 'contains'").join(barred, "head", "left_semi").select("tail")
    return nodes(spark, sf).where("kind = 'P'").select("qid").join(used, F.col("qid") == F.col("tail"), "left_anti").distinct()


@query("F10_eligible_edges", f"WITH {BASE} SELECT pid, count(*) AS n FROM edges WHERE head IN (SELECT qid FROM nodes WHERE has_image) AND tail IN (SELECT qid FROM nodes WHERE has_image) GROUP BY pid")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return graph.eligible_edges(edges(spark, sf), nodes(spark, sf).where("has_image")).groupBy("pid").agg(F.count("*").alias("n"))


@query("J01_semi_endpoints", f"WITH {BASE} SELECT head, pid, tail FROM edges WHERE pid = 'supplied_by' AND tail IN (SELECT qid FROM nodes WHERE has_image)")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where("pid = 'supplied_by'").join(nodes(spark, sf).where("has_image").select(F.col("qid").alias("tail")), "tail", "left_semi").select("head", "pid", "tail")


@query("J02_title_fallback", f"WITH {BASE} SELECT qid, coalesce(CASE WHEN has_image THEN title END, CASE WHEN kind <> 'P' THEN concat('alias ', kind) END, qid) AS label FROM nodes")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """A title by id, else an alias by kind, else the id."""
    n = nodes(spark, sf)
    titles = n.where("has_image").select("qid", F.col("title").alias("t"))
    alias = spark.createDataFrame([(k, f"alias {k}") for k in "RNCSO"], "kind string, a string")
    return n.select("qid", "kind").join(titles, "qid", "left").join(F.broadcast(alias), "kind", "left").select("qid", F.coalesce("t", "a", "qid").alias("label"))


@query("J03_relation_names", f"WITH {BASE} SELECT coalesce(name, pid) AS name, count(*) AS n FROM edges LEFT JOIN (SELECT * FROM relations WHERE tier <> 'plain') USING (pid) GROUP BY ALL")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    named = F.broadcast(relations(spark).where("tier <> 'plain'").select("pid", "name"))
    return edges(spark, sf).join(named, "pid", "left").groupBy(F.coalesce("name", "pid").alias("name")).agg(F.count("*").alias("n"))


@query("F11_rich_nodes", f"WITH {BASE} SELECT qid, degree FROM deg WHERE degree >= 30")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf)).where("degree >= 30").select("qid", "degree")


@query("F12_allowed_edges", f"WITH {BASE} SELECT pid, domain, is_1to1, count(*) AS n FROM allowed GROUP BY ALL")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return allowed(spark, sf).groupBy("pid", "domain", "is_1to1").agg(F.count("*").alias("n"))


@query("F13_anchor_pool", f"WITH {BASE} SELECT qid, count(*) AS n FROM allowed JOIN nodes ON qid = head WHERE has_image GROUP BY qid HAVING count(*) >= 2")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return graph.anchor_pool(nodes(spark, sf), allowed(spark, sf))


@query("F14_answer_validation", f"""WITH {BASE} SELECT qid FROM nodes WHERE lower(title) NOT IN ('small ring', 'red widget') AND kind <> 'R' AND length(title) >= 3 AND NOT regexp_matches(lower(title), '( bolt| gear|specified)$')""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """Not trivial, not popular, not short, no generic ending."""
    return nodes(spark, sf).where(~F.lower("title").isin("small ring", "red widget") & (F.col("kind") != "R") & (F.length("title") >= 3) & ~F.lower("title").rlike("( bolt| gear|specified)$")).select("qid")


@query("G02_neighbours", f"WITH {BASE}, b AS (SELECT head AS qid, pid, tail AS other, 'out' AS direction FROM edges UNION ALL SELECT tail, pid, head, 'in' FROM edges) SELECT qid, pid, name, other, direction FROM b JOIN relations USING (pid) WHERE qid IN (SELECT qid FROM nodes)")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every node, in both directions."""
    return graph.neighbours(edges(spark, sf), relations(spark), nodes(spark, sf))


@query("J06_siblings", f"WITH {BASE} SELECT a.head AS parent, a.tail AS target, count(*) AS siblings FROM edges a JOIN edges b ON a.head = b.head AND a.pid = b.pid AND a.tail <> b.tail WHERE a.pid = 'contains' GROUP BY ALL")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    """How many siblings each target has: one less than its parent has targets, so none are paired."""
    own = edges(spark, sf).where("pid = 'contains'")
    return own.join(own.groupBy("head").agg((F.count("*") - 1).alias("siblings")), "head").where("siblings > 0").select(F.col("head").alias("parent"), F.col("tail").alias("target"), "siblings")


@query("J07_distinguishing", f"""WITH {BASE}, g AS (SELECT DISTINCT head AS parent, pid AS via, tail AS target FROM edges WHERE pid = 'placed'),
h AS (SELECT DISTINCT g.*, x.direction, x.pid, x.value FROM g JOIN (SELECT head AS target, 'out' AS direction, pid, tail AS value FROM edges WHERE pid = 'contains' UNION ALL SELECT tail, 'in', pid, head FROM edges WHERE pid IN ('placed', 'contains')) x USING (target)),
own AS (SELECT parent, via, direction, pid, value, min(target) AS target FROM h GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY parent, via, target ORDER BY direction DESC, pid, value) AS n, count(*) FILTER (WHERE direction = 'out') OVER (PARTITION BY parent, via, target) AS outward FROM own WHERE (parent, via) IN (SELECT parent, via FROM g GROUP BY ALL HAVING count(*) > 1))
SELECT parent, via, target, direction, pid, value FROM r WHERE n <= 5 AND (direction = 'out' OR outward < 3)""")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    """What only one of a customer's orders has: parts first, then, where they are few, who points at it. Links may repeat, so no graph is stored."""
    e = links(spark, sf)
    return graph.distinguishing(e.where("pid = 'placed'"), e.where("pid = 'contains'"), e.where("pid IN ('placed', 'contains')"))


@query("J08_confirmation", f"WITH {BASE} SELECT head, min(tail) AS tail FROM edges JOIN relations USING (pid) WHERE tier <> 'boring' AND head NOT IN (SELECT a.tail FROM edges a JOIN edges b ON a.head = b.head AND a.pid = b.pid AND a.tail <> b.tail) GROUP BY head")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    """The first edge that is not boring, of nodes that are nobody's sibling."""
    e = edges(spark, sf)
    crowded = e.groupBy("head", "pid").agg(F.count("*").alias("n")).where("n > 1").join(e, ["head", "pid"]).select(F.col("tail").alias("head")).distinct()
    plain = e.join(F.broadcast(relations(spark).where("tier <> 'boring'").select("pid")), "pid", "left_semi")
    return plain.join(crowded, "head", "left_anti").groupBy("head").agg(F.min("tail").alias("tail"))


@query("J18_containment", f"WITH {BASE} SELECT count(*) AS missing FROM (SELECT head AS qid FROM edges UNION SELECT tail FROM edges) e WHERE qid NOT IN (SELECT qid FROM nodes)")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    ends = e.select(F.col("head").alias("qid")).union(e.select("tail")).distinct()
    return ends.join(nodes(spark, sf).select("qid"), "qid", "left_anti").agg(F.count("*").alias("missing"))


BFS = f"""{BASE}, samples AS (SELECT qid AS sample, qid AS anchor, concat('N', ('0x' || left(md5(qid), 8))::UBIGINT % 25) AS answer FROM nodes WHERE kind IN ('C', 'P')),
l1 AS (SELECT DISTINCT sample, tail AS node, answer FROM samples JOIN edges ON head = anchor),
l2 AS (SELECT DISTINCT sample, tail AS node, answer FROM l1 JOIN edges ON head = node WHERE node <> answer),
l3 AS (SELECT DISTINCT sample, tail AS node, answer FROM l2 JOIN edges ON head = node WHERE node <> answer),
found AS (SELECT sample, 1 AS hops FROM l1 WHERE node = answer UNION ALL SELECT sample, 2 FROM l2 WHERE node = answer UNION ALL SELECT sample, 3 FROM l3 WHERE node = answer)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where("kind IN ('C', 'P')").select(F.col("qid").alias("sample"), F.col("qid").alias("anchor"), F.concat(F.lit("N"), hash_number(F.col("qid")) % 25).alias("answer"))


@query("G03_bfs", f"WITH {BFS} SELECT sample, min(hops) AS hops FROM found GROUP BY sample")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reachable_within(samples(spark, sf), links(spark, sf), 3)


PATHS = f"""{BASE}, starts AS (SELECT qid FROM nodes WHERE kind = 'C' AND has_image),
p1 AS (SELECT [qid, tail] AS path, [pid] AS pids, domain AS last, tail AS node FROM starts JOIN allowed ON head = qid),
p2 AS (SELECT list_append(path, tail) AS path, list_append(pids, a.pid) AS pids, a.domain AS last, tail AS node FROM p1 JOIN allowed a ON head = node WHERE NOT list_contains(path, tail) AND a.domain <> p1.last),
p3 AS (SELECT list_append(path, tail) AS path, list_append(pids, a.pid) AS pids, a.domain AS last, tail AS node FROM p2 JOIN allowed a ON head = node WHERE NOT list_contains(path, tail) AND a.domain <> p2.last)"""


@query("G09_paths", f"WITH {PATHS} SELECT array_to_string(pids, '>') AS pattern, count(*) AS n, count(DISTINCT node) AS ends FROM p3 GROUP BY pattern")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    starts = nodes(spark, sf).where("kind = 'C' AND has_image").select("qid")
    found = graph.paths(starts, allowed(spark, sf), 3)
    return found.groupBy(F.array_join("pids", ">").alias("pattern")).agg(F.count("*").alias("n"), F.count_distinct("node").alias("ends"))


@query("J04_two_hops", f"WITH {PATHS} SELECT path[1] AS start, count(*) AS n FROM p2 GROUP BY ALL")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    starts = nodes(spark, sf).where("kind = 'C' AND has_image").select("qid")
    return graph.paths(starts, allowed(spark, sf), 2).groupBy(F.element_at("path", 1).alias("start")).agg(F.count("*").alias("n"))


@query("J05_no_cycles", f"WITH {BASE} SELECT count(*) AS n FROM edges a JOIN edges b ON b.head = a.tail WHERE b.tail <> a.head AND b.tail <> a.tail")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hop walks that visit no node twice: in-degree times out-degree of the middle, less those that turn back. No walk is made."""
    e = edges(spark, sf).where("head <> tail")
    loops = edges(spark, sf).where("head = tail").groupBy(F.col("head").alias("middle")).agg(F.count("*").alias("loops"))
    into, out = e.groupBy(F.col("tail").alias("middle")).agg(F.count("*").alias("i")), e.groupBy(F.col("head").alias("middle")).agg(F.count("*").alias("o"))
    all_walks = into.join(out, "middle", "outer").join(loops, "middle", "left").select(F.sum((F.coalesce("i", F.lit(0)) + F.coalesce("loops", F.lit(0))) * F.coalesce("o", F.lit(0))).alias("n"))
    # both directions of a pair in one group: each way there has each way back
    pairs = e.groupBy(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(F.count_if(F.col("head") < F.col("tail")).alias("up"), F.count_if(F.col("head") > F.col("tail")).alias("down"))
    back = pairs.select(F.sum(2 * F.col("up") * F.col("down")).alias("b"))
    return all_walks.crossJoin(back).select((F.col("n") - F.coalesce("b", F.lit(0))).alias("n"))


FAN = "fan AS (SELECT head AS qid, count(*) AS out_edges FROM allowed GROUP BY head)"
def weight_sql(branching: str, uses: str) -> str:
    base = f"CASE WHEN {branching} AND NOT is_1to1 THEN 10.0::DOUBLE WHEN {branching} THEN 1.0 WHEN is_1to1 THEN 5.0 ELSE 3.0 END"
    return f"greatest(0.01::DOUBLE, CASE WHEN coalesce(out_edges, 0) = 0 THEN 0.1 ELSE ({base}) * (CASE tier WHEN 'interesting' THEN 5.0 WHEN 'boring' THEN 0.2 ELSE 1.0 END) * (CASE WHEN {uses} >= 2 THEN 0.1 ELSE 1.0 END) * (CASE WHEN out_edges >= 3 THEN 2.0 WHEN out_edges = 1 THEN 0.5 ELSE 1.0 END) END)"


def md5_sql(*parts: str) -> str:
    return "('0x' || left(md5(concat_ws('|', " + ", ".join(parts) + ")), 8))::UBIGINT"


def with_fan(spark: SparkSession, sf: str) -> DataFrame:
    return allowed(spark, sf).join(fan(spark, sf), "tail", "left").withColumn("out_edges", F.coalesce("out_edges", F.lit(0)))


@query("G05_edge_weights", f"WITH {BASE}, {FAN}, a AS (SELECT *, {md5_sql('head')} % 2 = 0 AS branching, {md5_sql('tail')} % 4 AS uses FROM allowed LEFT JOIN fan ON qid = tail) SELECT pid, branching, uses::BIGINT AS uses, round({weight_sql('branching', 'uses')}, 6) AS weight, count(*) AS n FROM a GROUP BY ALL")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    """Weights over every factor: type, branching, tier, domain reuse and fan-out."""
    e = with_fan(spark, sf).withColumns({"branching": hash_number(F.col("head")) % 2 == 0, "uses": hash_number(F.col("tail")) % 4})
    w = graph.edge_weight(F.col("is_1to1"), F.col("branching"), F.col("tier"), F.col("uses"), F.col("out_edges"))
    return e.groupBy("pid", "branching", "uses", F.round(w, 6).alias("weight")).agg(F.count("*").alias("n"))


@query("D13_weighted_pick", f"""WITH {BASE}, {FAN}, c AS (SELECT head, tail, -ln((('0x' || left(md5(concat_ws('|', 's', head, '0', pid, tail)), 8))::UBIGINT + 1) / 4294967297.0::DOUBLE) / {weight_sql('true', '0')} AS k FROM allowed LEFT JOIN fan ON qid = tail)
SELECT head, arg_min(tail, k) AS tail FROM c GROUP BY head""")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    w = graph.edge_weight(F.col("is_1to1"), F.lit(True), F.col("tier"), F.lit(0), F.col("out_edges"))
    rows = with_fan(spark, sf).select("head", "pid", "tail", w.alias("w"))
    return graph.weighted_pick(rows, ["head"], F.concat_ws("|", F.lit("s"), "head", F.lit("0"), "pid", "tail"), F.col("w")).select("head", "tail")


def walk_sql(hops: int, seed: str) -> str:
    """The weighted walks hop by hop: candidates, weights, the least -ln(u) / w of each walk."""
    parts = ["s0 AS (SELECT qid AS walk, [qid] AS path, []::VARCHAR[] AS pids, []::VARCHAR[] AS domains, qid AS node FROM nodes WHERE kind = 'C' AND has_image)"]
    for h in range(hops):
        branching = f"({md5_sql(repr(seed), 'walk', repr('branch'))} % {max(1, hops - 2)} + 1 = {h})"
        weight = weight_sql(branching, "len(list_filter(domains, lambda d: d = domain))")
        parts += [
            f"c{h} AS (SELECT walk, path, pids, domains, a.pid, a.tail AS next, a.domain, a.is_1to1, a.tier, out_edges FROM s{h} JOIN allowed a ON a.head = node LEFT JOIN fan ON fan.qid = a.tail WHERE NOT list_contains(path, a.tail) AND len(list_filter(pids, lambda p: p = a.pid)) < 2 AND (len(domains) = 0 OR domains[-1] <> a.domain))",
            f"k{h} AS (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY -ln(({md5_sql(repr(seed), 'walk', repr(str(h)), 'pid', 'next')} + 1) / 4294967297.0::DOUBLE) / {weight}) AS r FROM c{h})",
            f"s{h + 1} AS (SELECT walk, list_append(path, next) AS path, list_append(pids, pid) AS pids, list_append(domains, domain) AS domains, next AS node FROM k{h} WHERE r = 1)",
            f"e{h} AS (SELECT * FROM s{h} WHERE walk NOT IN (SELECT walk FROM s{h + 1}))",
        ]
    parts.append("walks AS (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in [*(f"e{h}" for h in range(hops)), f"s{hops}"]) + ")")
    return ",\n".join(parts)


def walks(spark: SparkSession, sf: str, hops: int, seed: str) -> DataFrame:
    return graph.walk(nodes(spark, sf).where("kind = 'C' AND has_image").select("qid"), allowed(spark, sf), hops, seed, fan(spark, sf))


@query("G04_weighted_walk", f"WITH {BASE}, {FAN}, {walk_sql(4, 's')} SELECT walk, array_to_string(path, '>') AS path, array_to_string(pids, '>') AS pids, len(pids)::INT AS hops FROM walks")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return walks(spark, sf, 4, "s").select("walk", F.array_join("path", ">").alias("path"), F.array_join("pids", ">").alias("pids"), "hops")


TYPED = """typed AS (SELECT w.*, list_transform(path[2:], lambda q: ('0x' || left(md5(q), 8))::UBIGINT % 2 = 0) AS images, (SELECT any_value(title) FROM nodes n WHERE n.qid = path[-1]) AS answer FROM walks w WHERE len(pids) >= 3),
first AS (SELECT *, list_reduce([{'t': []::VARCHAR[], 'p': 0, 'im': false}] || list_transform(images, lambda im: {'t': []::VARCHAR[], 'p': 0, 'im': im}),
  lambda s, r: CASE WHEN len(s.t) = 0 OR (r.im AND s.t[-1] = 'K' AND s.p < 3) THEN {'t': list_append(s.t, 'P'), 'p': s.p + 1, 'im': false} ELSE {'t': list_append(s.t, 'K'), 'p': s.p, 'im': false} END).t AS t0 FROM typed),
upgraded AS (SELECT *, list_reduce([{'t': []::VARCHAR[], 'p': len(list_filter(t0, lambda x: x = 'P')), 'k': '', 'im': false}] || list_transform(list_zip(t0, images), lambda z: {'t': []::VARCHAR[], 'p': 0::BIGINT, 'k': z[1], 'im': z[2]}),
  lambda s, r: CASE WHEN r.k = 'K' AND len(s.t) > 0 AND r.im AND s.t[-1] = 'K' AND s.p < 2 THEN {'t': list_append(s.t, 'P'), 'p': s.p + 1, 'k': '', 'im': false} ELSE {'t': list_append(s.t, r.k), 'p': s.p, 'k': '', 'im': false} END).t AS types FROM first)"""


@query("G07_accepted_walks", f"""WITH {BASE}, {FAN}, {walk_sql(4, 's')}, {TYPED},
confirming AS (SELECT head, tail FROM edges JOIN relations USING (pid) WHERE tier <> 'boring')
SELECT walk, array_to_string(path, '>') AS path, array_to_string(types, '') AS types, answer, min(tail) AS "constraint" FROM upgraded JOIN confirming ON head = path[-1]
WHERE NOT list_contains(path, tail) AND len(list_filter(types, lambda t: t = 'P')) >= 2 AND len(list_distinct(domains)) >= 3 AND len(list_filter(domains, lambda d: d = 'GEO')) <= 2 AND length(answer) >= 2 AND NOT regexp_matches(lower(answer), '( language| province| region| county| district| prefecture)$') GROUP BY ALL""")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of three hops or more whose answer can be confirmed and asked for."""
    e = edges(spark, sf).join(F.broadcast(relations(spark).where("tier <> 'boring'").select("pid")), "pid", "left_semi").select("head", "tail")
    found = graph.accepted(walks(spark, sf, 4, "s"), nodes(spark, sf), e)
    return found.select("walk", F.array_join("path", ">").alias("path"), F.array_join("types", "").alias("types"), "answer", "constraint")


@query("G08_batch_walks", f"WITH {BASE}, {FAN}, {walk_sql(3, 'batch')} SELECT path[1] AS start, path[-1] AS \"end\", min(walk) AS walk, len(any_value(pids))::INT AS hops FROM walks GROUP BY path[1], path[-1] ORDER BY walk LIMIT 500")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    """Many walks at once, then one for each start and end and a quota, the feature of the loop; no retries."""
    ends = walks(spark, sf, 3, "batch").select(F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"), "walk", "hops")
    return first_of(ends, ["start", "end"], "walk").orderBy("walk").limit(500)


@query("G08_batch_caps", f"""WITH {BASE}, {FAN}, {walk_sql(3, 'batch')}, a AS (SELECT path[1] AS start, path[-1] AS "end", substr(walk, 2)::BIGINT AS attempt FROM walks),
f AS (SELECT "end", min(attempt) AS attempt FROM a WHERE attempt <= 4000 GROUP BY "end"), t AS (SELECT * FROM f ORDER BY attempt, "end" LIMIT 200),
g AS (SELECT *, attempt - coalesce(lag(attempt) OVER (ORDER BY attempt, "end"), 0) AS gap FROM t), s AS (SELECT *, max((gap > 12)::INT) OVER (ORDER BY attempt, "end" ROWS UNBOUNDED PRECEDING) AS stopped FROM g)
SELECT "end", attempt FROM s WHERE stopped = 0""")
def g08_caps(spark: SparkSession, sf: str) -> DataFrame:
    """One walk for each end in the order of attempts: at most 200, out of 4,000 attempts, until 12 in a row bring nothing new."""
    ends = walks(spark, sf, 3, "batch").select(F.element_at("path", -1).alias("end"), F.substring("walk", 2, 20).cast("long").alias("attempt"))
    return graph.batch(ends, ["end"], "attempt", wanted=200, dry=12, cap=4000)


@query("A04_hop_distribution", f"WITH {PATHS}, u AS (SELECT pids FROM p2 UNION ALL SELECT pids FROM p3) SELECT len(pids)::INT AS hops, count(*) AS n, round(avg(len(list_distinct(pids))), 6) AS relations FROM u GROUP BY ALL")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    starts = nodes(spark, sf).where("kind = 'C' AND has_image").select("qid")
    al = allowed(spark, sf)
    both = graph.paths(starts, al, 2).select("pids").union(graph.paths(starts, al, 3).select("pids"))
    return both.groupBy(F.size("pids").alias("hops")).agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.array_distinct("pids"))), 6).alias("relations"))


@query("W13_domain_change", f"WITH {PATHS} SELECT count(*) AS n FROM p2")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    starts = nodes(spark, sf).where("kind = 'C' AND has_image").select("qid")
    return graph.paths(starts, allowed(spark, sf), 2).agg(F.count("*").alias("n"))


@query("G06_hop_types", """WITH c AS (SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 3 = 0 AS image FROM orders),
l AS (SELECT c, list(image ORDER BY i) AS images FROM c WHERE i <= 6 GROUP BY c),
f AS (SELECT c, images, list_reduce([{'t': []::VARCHAR[], 'p': 0, 'im': false}] || list_transform(images, lambda im: {'t': []::VARCHAR[], 'p': 0, 'im': im}),
  lambda s, r: CASE WHEN len(s.t) = 0 OR (r.im AND s.t[-1] = 'K' AND s.p < 3) THEN {'t': list_append(s.t, 'P'), 'p': s.p + 1, 'im': false} ELSE {'t': list_append(s.t, 'K'), 'p': s.p, 'im': false} END).t AS t0 FROM l)
SELECT c, array_to_string(t0, '') AS types, array_to_string(list_reduce([{'t': []::VARCHAR[], 'p': len(list_filter(t0, lambda x: x = 'P')), 'k': '', 'im': false}] || list_transform(list_zip(t0, images), lambda z: {'t': []::VARCHAR[], 'p': 0::BIGINT, 'k': z[1], 'im': z[2]}),
  lambda s, r: CASE WHEN r.k = 'K' AND len(s.t) > 0 AND r.im AND s.t[-1] = 'K' AND s.p < 3 THEN {'t': list_append(s.t, 'P'), 'p': s.p + 1, 'k': '', 'im': false} ELSE {'t': list_append(s.t, r.k), 'p': s.p, 'k': '', 'im': false} END).t, '') AS upgraded FROM f""")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    """P or K for each hop, and the same after the upgrade that wants three."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey")
    chains = o.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("o_orderkey")), 1, 6).alias("keys"))
    images = F.transform("keys", lambda k: k % 3 == 0)
    types = graph.hop_types(images)
    return chains.select("c", F.array_join(types, "").alias("types"), F.array_join(graph.upgraded_types(types, images, 3), "").alias("upgraded"))


@query("W14_geo_quota", """WITH RECURSIVE p AS (SELECT p_partkey, p_size % 2 = 0 AS geo, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
q AS (SELECT 0::BIGINT AS i, 0::BIGINT AS g, 0::BIGINT AS n, NULL::BIGINT AS p_partkey, false AS kept
  UNION ALL SELECT p.i, g + (geo AND (n = 0 OR (g + 1)::DOUBLE / (n + 1) <= 0.35))::INT, n + (NOT geo OR n = 0 OR (g + 1)::DOUBLE / (n + 1) <= 0.35)::INT, p.p_partkey, NOT geo OR n = 0 OR (g + 1)::DOUBLE / (n + 1) <= 0.35 FROM q JOIN p ON p.i = q.i + 1)
SELECT p_partkey FROM q WHERE kept""")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("geo"))
    return graph.with_quota(rows, "p_partkey", "geo", 0.35)


SAMPLES = """smp AS (SELECT o_orderkey AS sample, concat('Which nation is tied to ', CASE WHEN o_orderkey % 9 = 0 THEN concat('nation_', c_nationkey) ELSE o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' in the picture?' END) AS question,
  concat('NATION_', c_nationkey) AS answer, concat('N', c_nationkey) AS answer_qid, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'C' ELSE 'O' END, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_orderkey END) AS anchor_qid, 2 AS num_hops,
  [concat('C', o_custkey), concat('N', CASE WHEN o_orderkey % 13 = 0 THEN 999 ELSE c_nationkey END)] AS chain, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 11) * 1000 END AS image_bytes, [CASE WHEN o_orderkey % 17 = 0 THEN concat('nation_', c_nationkey) ELSE 'x' END] AS titles
  FROM orders JOIN customer ON c_custkey = o_custkey),
near AS (SELECT head AS a, tail AS b FROM edges UNION SELECT tail, head FROM edges),
judged AS (SELECT sample, CASE WHEN contains(lower(question), lower(answer)) THEN 'answer_leak' WHEN EXISTS (SELECT 1 FROM near WHERE a = anchor_qid AND b = answer_qid) THEN 'anchor_answer_shortcut' WHEN answer_qid IN ('N0', 'N7') THEN 'popularity_bias'
  WHEN chain[1] NOT IN (SELECT qid FROM nodes) OR chain[2] NOT IN (SELECT qid FROM nodes) THEN 'missing_intermediate' WHEN image_bytes IS NULL THEN 'no_image' WHEN image_bytes < 5000 THEN 'tiny_image' WHEN length(answer) < 2 THEN 'answer_too_short' WHEN length(question) < 30 THEN 'question_too_short' WHEN lower(titles[1]) = lower(answer) THEN 'constraint_is_answer' END AS reason FROM smp)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k, nation = F.col("o_orderkey"), F.col("c_nationkey")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        k.alias("sample"),
        F.concat(F.lit("Which nation is tied to "), F.when(k % 9 == 0, F.concat(F.lit("nation_"), nation)).otherwise(F.col("o_orderpriority")), F.when(k % 5 == 0, "").otherwise(" in the picture?")).alias("question"),
        F.concat(F.lit("NATION_"), nation).alias("answer"), F.concat(F.lit("N"), nation).alias("answer_qid"), F.when(k % 4 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(F.concat(F.lit("O"), k)).alias("anchor_qid"), F.lit(2).alias("num_hops"),
        F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("N"), F.when(k % 13 == 0, 999).otherwise(nation))).alias("chain"), F.when(k % 7 != 0, (k % 11) * 1000).alias("image_bytes"), F.array(F.when(k % 17 == 0, F.concat(F.lit("nation_"), nation)).otherwise("x")).alias("constraint_titles"),
    )
    return filters.rule_reason(rows, edges(spark, sf), nodes(spark, sf).withColumn("summary", F.lit("")), ["N0", "N7"])


@query("F15_ordered_rules", f"WITH {BASE}, {SAMPLES} SELECT sample, reason FROM judged")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("sample", "reason")


@query("F16_rejection_stats", f"WITH {BASE}, {SAMPLES} SELECT coalesce('rule:' || reason, 'passed') AS outcome, count(*) AS n FROM judged GROUP BY ALL")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return filters.rejections(judged(spark, sf))


@query("D05_dedup_pairs", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS m FROM a WHERE n = 1) SELECT l_suppkey, count(*) AS n FROM b WHERE m = 1 GROUP BY ALL")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    """First by one pair, then by another, in sequence."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("o"))
    one = first_of(rows, ["l_partkey", "l_suppkey"], "o").select("l_suppkey", "o.l_orderkey", F.struct("o.l_linenumber", "l_partkey").alias("p"))
    return first_of(one, ["l_orderkey", "l_suppkey"], "p").groupBy("l_suppkey").agg(F.count("*").alias("n"))
