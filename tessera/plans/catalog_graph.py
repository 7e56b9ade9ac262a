"""Queries on graphs: trade between nations, transitions between events, chains of customers, the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import graph as gr
from tessera.operators.graph import Graph
from tessera.plans.registry import query
from tessera.sources.generators import from_lists

_TRADE = """trade as (select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, cast(sum(cast(l_quantity as bigint)) as bigint) as value
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"""
_NET = _TRADE + """, net as (select a.src, a.dst, a.value - coalesce(b.value, 0) as value from trade a left join trade b on a.src = b.dst and a.dst = b.src where a.src <> a.dst and a.value > coalesce(b.value, 0))"""
_IDS = "ids as (select src as id from trade union select dst from trade)"


def _trade(t) -> Graph:
    l = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    o = t.orders.select("o_orderkey", "o_custkey")
    c, s = t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("src")), t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph.of(gr.checkpointed(joined.groupBy("src", "dst").agg(F.sum("q").alias("value"))))


def _net(t) -> Graph:
    g = _trade(t)
    back = g.edges.select(F.col("dst").alias("s"), F.col("src").alias("d"), F.col("value").alias("b"))
    e = g.edges.join(back, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left").where("src <> dst").withColumn("value", F.col("value") - F.coalesce("b", F.lit(0))).where("value > 0")
    return Graph(g.vertices, gr.checkpointed(e.select("src", "dst", "value")))


def _chains(t) -> Graph:
    """Customers of a nation and segment, each linked to the next."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    e = t.customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst")).where("dst is not null")
    return Graph.of(e, t.customer.select(F.col("c_custkey").alias("id")), directed=False)


_REGIONS = _TRADE + """, flow as (select a.n_regionkey::bigint as src, b.n_regionkey::bigint as dst, sum(value)::bigint as value from trade join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey where a.n_regionkey <> b.n_regionkey group by 1, 2)"""


def _regions(t) -> Graph:
    """Trade between regions."""
    e = _trade(t).edges
    a, b = (t.nation.select(F.col("n_nationkey").alias(n), F.col("n_regionkey").cast("long").alias(r)) for n, r in (("src", "a"), ("dst", "b")))
    met = e.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("value").alias("value"))
    return Graph.of(gr.checkpointed(met))


def _places(t) -> Graph:
    """Region, nation, customer; ids rise from the roots on."""
    a = t.nation.select(F.concat(F.lit("a"), "n_regionkey").alias("src"), F.concat(F.lit("b"), "n_nationkey").alias("dst"))
    b = t.customer.select(F.concat(F.lit("b"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return Graph.of(a.unionAll(b))


_PLACES = """select 'a' || n_regionkey as start, 'a' || n_regionkey as id, ['a' || n_regionkey] as way from nation group by 1, 2, 3 union all select 'a' || n_regionkey, 'b' || n_nationkey, ['a' || n_regionkey, 'b' || n_nationkey] from nation
 union all select 'a' || n_regionkey, 'c' || c_custkey, ['a' || n_regionkey, 'b' || n_nationkey, 'c' || c_custkey] from customer join nation on c_nationkey = n_nationkey"""


def _tree(t) -> Graph:
    a = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return Graph.of(a.unionAll(b))


@query("graph_edges", f"with {_TRADE} select * from trade")
def _(t):
    return _trade(t).edges


@query("graph_degrees", f"with {_TRADE}, {_IDS} select id, (select count(*) from trade where src = id) as out_degree, (select count(*) from trade where dst = id) as in_degree from ids")
def _(t):
    return _trade(t).degrees()


@query("graph_lookups", f"with {_NET} select r_regionkey as id, 'to' as way, dst as other from region join net on src = r_regionkey union all select r_regionkey, 'from', src from region join net on dst = r_regionkey")
def _(t):
    g, ids = _net(t), t.region.select(F.col("r_regionkey").alias("id"))
    return g.successors(ids).select("id", F.lit("to").alias("way"), "other").unionAll(g.predecessors(ids).select("id", F.lit("from").alias("way"), "other"))


@query("graph_neighbours", f"with {_NET} select distinct id, other from (select src as id, dst as other from net union all select dst, src from net)")
def _(t):
    g = _net(t)
    return g.neighbours(g.vertices)


@query("graph_reversed_where", f"with {_NET} select dst as src, src as dst, value from net where src < 20 and dst < 20 and value > 5")
def _(t):
    return _net(t).where(F.col("id") < 20, F.col("value") > 5).reversed().edges


@query("graph_map", f"with {_NET} select src % 5 as src, dst % 5 as dst, max(value * 2) as value from net group by 1, 2")
def _(t):
    return _net(t).map(lambda v: v % 5, lambda x: x * 2).edges


@query("graph_edit", f"with {_NET} select * from net where src <> 3 and dst <> 3 and not (src = 1 and dst = 2) and not (src = 100 and dst = 1) union all select 100, 1, 7")
def _(t):
    one = lambda sql: t.spark.range(1).selectExpr(*sql)
    g = _net(t).remove_vertices(one(["3L as id"])).remove_edges(one(["1L as src", "2L as dst"]))
    return g.add_edges(one(["100L as src", "1L as dst", "7L as value"])).add_vertices(one(["200L as id"])).edges


@query("graph_union", f"with {_NET}, other as (select dst as src, src as dst, value from net union all select src, dst, value from net where src < dst) select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, coalesce(a.value, 0) + coalesce(b.value, 0) as value from net a full join other b on a.src = b.src and a.dst = b.dst")
def _(t):
    g = _net(t)
    other = Graph(g.vertices, g.reversed().edges.unionByName(g.edges.where("src < dst")))
    return g.union(other, lambda a, b: a + b).edges


@query("graph_intersection", f"with {_NET}, {_TRADE.replace('trade as', 'trade2 as')} select a.src, a.dst, b.value from net a join trade2 b on a.src = b.src and a.dst = b.dst where a.value < b.value")
def _(t):
    return _net(t).intersection(_trade(t), same=lambda a, b: a < b).edges


@query("graph_complement", f"with {_NET}, ids as (select src as id from trade union select dst from trade) select a.id as src, b.id as dst from ids a, ids b where a.id <> b.id and not exists (select 1 from net where src = a.id and dst = b.id)")
def _(t):
    return _net(t).complement().edges.select("src", "dst")


@query("graph_from_lists", "select n_regionkey as src, n_nationkey as dst, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as ord from nation")
def _(t):
    lists = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("l"))
    return from_lists(lists, "n_regionkey", "l")


def _factory_sql(body: str) -> str:
    return f"with e as ({body}) select src, dst from e"


@query("graph_complete", _factory_sql("select a.range as src, b.range as dst from range(12) a, range(12) b where a.range <> b.range"))
def _(t):
    return gr.complete(t.spark, 12).edges.select("src", "dst")


@query("graph_partite", _factory_sql("select a.range as src, b.range as dst from range(9) a, range(9) b where (case when a.range < 2 then 0 when a.range < 5 then 1 else 2 end) < (case when b.range < 2 then 0 when b.range < 5 then 1 else 2 end)"))
def _(t):
    return gr.partite(t.spark, [2, 3, 4]).edges.select("src", "dst")


@query("graph_path_ring_star", "select 'path' as kind, range as src, range + 1 as dst from range(9) union all select 'ring', range, (range + 1) % 10 from range(10) union all select 'star', 0, range from range(1, 10)")
def _(t):
    made = {"path": gr.path(t.spark, 10), "ring": gr.ring(t.spark, 10), "star": gr.star(t.spark, 10), "empty": gr.empty(t.spark, 10)}
    out = [g.edges.select(F.lit(k).alias("kind"), "src", "dst") for k, g in made.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("graph_trees", "select 'complete' as kind, (range - 1) // 3 as src, range as dst from range(1, 20) union all select 'perfect', (range - 1) // 2, range from range(1, 15)")
def _(t):
    a, b = gr.complete_tree(t.spark, 20, 3).edges, gr.perfect_tree(t.spark, 3).edges
    return a.select(F.lit("complete").alias("kind"), "src", "dst").unionAll(b.select(F.lit("perfect").alias("kind"), "src", "dst"))


@query("graph_random", "select true as inside, true as loopless, true as single, true as even, true as repeatable, cast(0 as bigint) as none, cast(39 * 40 as bigint) as every")
def _(t):
    """What holds for any draw: ends are vertices, no loops, no repeats, about as many edges as expected (six deviations of 219), the same again."""
    make = lambda p, n=1000: gr.random_graph(t.spark, n, p, seed=1).edges.select("src", "dst")
    e = gr.checkpointed(make(0.05))
    checks = e.agg(F.coalesce(F.bool_and((F.col("src") >= 0) & (F.col("src") < 1000) & (F.col("dst") >= 0) & (F.col("dst") < 1000)), F.lit(False)).alias("inside"), F.bool_and(F.col("src") != F.col("dst")).alias("loopless"), (F.count("*") == F.count_distinct("src", "dst")).alias("single"), (F.abs(F.count("*") - 49950) < 1320).alias("even"))
    same = e.exceptAll(make(0.05)).agg((F.count("*") == 0).alias("repeatable"))
    return checks.crossJoin(same).crossJoin(make(0.0).agg(F.count("*").alias("none"))).crossJoin(make(1.0, 40).agg(F.count("*").alias("every")))


@query("graph_breadth_first", "select 'r' || r_regionkey as id, cast(0 as bigint) as depth from region where r_regionkey in (select n_regionkey from nation) union all select 'n' || n_nationkey, 1 from nation union all select 'c' || c_custkey, 2 from customer")
def _(t):
    g = _tree(t)
    return gr.breadth_first(g, g.vertices.where(F.col("id").startswith("r")))


@query("graph_connected", "select c_custkey as id, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as component from customer")
def _(t):
    return gr.connected(_chains(t))


@query("graph_union_find", "with c as (select c_custkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as component from customer) select component, count(*) as size from c group by 1")
def _(t):
    return gr.connected(_chains(t)).groupBy("component").agg(F.count("*").alias("size"))


@query("graph_topological", "select 'r' || r_regionkey as id, cast(0 as bigint) as layer from region where r_regionkey in (select n_regionkey from nation) union all select 'n' || n_nationkey, 1 from nation union all select 'c' || c_custkey, 2 from customer")
def _(t):
    return gr.topological(_tree(t))


_REACH = ", r0 as (select src, dst from net union select id, id from ids), " + ", ".join(f"r{k + 1} as (select distinct a.src, b.dst from r{k} a join r{k} b on a.dst = b.src)" for k in range(5))


@query("graph_strongly_connected", f"with {_NET}, {_IDS}{_REACH} select a.src as id, min(a.dst) as component from r5 a join r5 b on a.src = b.dst and a.dst = b.src group by 1")
def _(t):
    return gr.strongly_connected(_net(t))


@query("graph_has_cycle", f"with {_NET}, {_IDS}{_REACH} select exists (select 1 from r5 a join net b on a.src = b.dst and a.dst = b.src) as cyclic, false as tree_cyclic, false as bipartite, true as tree_bipartite")
def _(t):
    tree, net = _tree(t), _net(t)
    odd = gr.bipartite(Graph.of(gr.complete(t.spark, 3).edges, directed=False))
    return gr.cyclic(net).crossJoin(gr.cyclic(tree).withColumnRenamed("cyclic", "tree_cyclic")).crossJoin(odd).crossJoin(gr.bipartite(tree).withColumnRenamed("bipartite", "tree_bipartite"))


def _closure(start: str, join: str) -> str:
    return f", d0 as ({start}), " + ", ".join(f"d{k + 1} as (select a.src, b.dst, min({join}) as cost from d{k} a join d{k} b on a.dst = b.src group by 1, 2)" for k in range(5))


_SHORT = _closure("select src, dst, min(cost) as cost from (select src, dst, value::double as cost from net union all select id, id, 0.0::double from ids) group by 1, 2", "a.cost + b.cost")


@query("graph_shortest_paths", f"with {_NET}, {_IDS}{_SHORT} select dst as id, cost from d5 where src = (select min(id) from ids)")
def _(t):
    g = _net(t)
    return gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id"))).select("id", "cost")


@query("graph_shortest_paths_negative", f"with {_NET}, {_IDS}, dag as (select src, dst, value from net where src < dst){_SHORT.replace('from net', 'from (select src, dst, -value as value from dag)')} select dst as id, cost from d5 where src = (select min(id) from ids)")
def _(t):
    g = _net(t).where(edge=F.col("src") < F.col("dst"))
    return gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id")), -F.col("value"), negative=True).select("id", "cost")


@query("graph_all_pairs", f"with {_NET}, {_IDS}{_SHORT} select src, dst, cost from d5")
def _(t):
    return gr.all_pairs(_net(t))


@query("graph_tight_edges", f"with {_NET}, {_IDS}{_SHORT}, p as (select dst as id, cost from d5 where src = (select min(id) from ids)) select src, dst from net join p a on a.id = src join p b on b.id = dst where a.cost + value = b.cost")
def _(t):
    g = _net(t)
    return gr.tight_edges(g, gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id"))))


_FULL = _SHORT.replace("value::double as cost from net", "value::double as cost from trade")
_TIGHT = ", ends as (select min(id) as a, max(id) as z from ids), p as (select dst as id, cost from d5, ends where src = a), tight as (select distinct src, dst from trade join p a on a.id = src join p b on b.id = dst where a.cost + value = b.cost and src <> dst)"
_WITH = f"with recursive {_TRADE}, {_IDS}{_FULL}{_TIGHT}"


@query("graph_path_cost", _WITH + ", way(target, back, id) as (select z, cast(0 as bigint), z from ends union all select target, back + 1, (select min(src) from tight where dst = way.id) from way where exists (select 1 from tight where dst = way.id)) select target, back, way.id, cost from way join p on p.id = way.id")
def _(t):
    g = _trade(t)
    last = g.vertices.agg(F.max("id").alias("id"))
    return gr.path_to(gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id")), targets=last), last)


@query("graph_all_shortest_paths", _WITH + ", way(id, route) as (select z, [z] from ends union all select src, list_prepend(src, route) from way join tight on dst = way.id) select array_to_string(route, ',') as route from way, ends where way.id = a")
def _(t):
    g = _trade(t)
    last = g.vertices.agg(F.max("id").alias("id"))
    routes = gr.all_paths_to(g, gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id"))), last)
    return routes.select(F.array_join(F.transform("route", lambda v: v.cast("string")), ",").alias("route"))


@query("graph_informed_search", _WITH + " select id, cost from p, ends where id = z")
def _(t):
    """With the smallest cost of any edge as what is left to the target at least."""
    g = _trade(t)
    least = g.edges.agg(F.min("value")).first()[0]
    last = g.vertices.agg(F.max("id").alias("id"))
    left = F.when(F.col("id") == last.first()[0], F.lit(0.0)).otherwise(F.lit(float(least)))
    found = gr.shortest_paths(g, g.vertices.agg(F.min("id").alias("id")), targets=last, heuristic=left)
    return found.join(last, "id", "left_semi").select("id", "cost")


_FLAT = ", u as (select least(src, dst) as a, greatest(src, dst) as b, min(value * 10000 + src * 100 + dst) as w from trade where src <> dst group by 1, 2)"
_BOTTLE = _closure("select src, dst, min(cost) as cost from (select a as src, b as dst, w as cost from u union all select b, a, w from u union all select id, id, 0 from ids) group by 1, 2", "greatest(a.cost, b.cost)")


@query("graph_spanning_forest", f"with {_TRADE}, {_IDS}{_FLAT}{_BOTTLE} select a as src, b as dst, w as value from u join d5 on src = a and dst = b where w = cost")
def _(t):
    g = _trade(t)
    e = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.col("value") * 10000 + F.col("src") * 100 + F.col("dst")).alias("value"))
    flat = Graph.of(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "value"), g.vertices, directed=False)
    return gr.spanning_forest(flat)


@query("graph_spanning_tree_from", "with c as (select c_custkey, lead(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_custkey) as dst, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as root from customer) select c_custkey as src, dst from c where dst is not null and root = (select root from c where c_custkey = (select min(c_custkey) from customer))")
def _(t):
    start = t.customer.agg(F.min("c_custkey")).first()[0]
    return gr.spanning_tree_from(_chains(t), start).select("src", "dst")


@query("graph_edge_path_values", f"with {_NET} select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from net group by 1, 2")
def _(t):
    return _net(t).edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


@query("graph_depth_first", f"select id, start, row_number() over (partition by start order by way) - 1 as place from ({_PLACES})")
def _(t):
    return gr.depth_first(_places(t))


@query("graph_depth_first_post_order", f"select id, start, row_number() over (partition by start order by list_append(way, '~')) - 1 as place from ({_PLACES})")
def _(t):
    return gr.depth_first(_places(t), post=True)


@query("graph_random_walk", f"with {_NET}, {_IDS} select id as start, true as along_edges, true as self_avoiding, true as ends_rightly from ids")
def _(t):
    """What holds for any walk: it follows edges, meets no vertex twice, and stops after 8 steps or where no edge leads on."""
    g = _net(t)
    walk = gr.checkpointed(gr.random_walk(g, g.vertices, 8, seed=2, self_avoiding=True))
    back = walk.select(F.col("start").alias("s"), (F.col("step") + 1).alias("n"), F.col("id").alias("src"))
    steps = walk.where("step > 0").join(back, (F.col("start") == F.col("s")) & (F.col("step") == F.col("n")), "left").join(g.edges.select("src", F.col("dst").alias("id"), F.lit(1).alias("hit")), ["src", "id"], "left")
    edges = steps.groupBy("start").agg(F.bool_and(F.col("hit").isNotNull()).alias("along"))
    whole = walk.groupBy("start").agg((F.count("*") == F.count_distinct("id")).alias("self_avoiding"), F.max("step").alias("last"), F.collect_set("id").alias("been"), F.max_by("id", "step").alias("at"))
    on = whole.join(g.edges, F.col("at") == F.col("src"), "left").groupBy("start", "self_avoiding", "last").agg(F.bool_or(F.col("dst").isNotNull() & ~F.array_contains("been", F.col("dst"))).alias("more"))
    return on.join(edges, "start", "left").select("start", F.coalesce("along", F.lit(True)).alias("along_edges"), "self_avoiding", ((F.col("last") == 8) | ~F.coalesce("more", F.lit(False))).alias("ends_rightly"))


_SETS = ", v as (select list(id order by id) as l from (select distinct src as id from flow union select dst from flow)), cuts as (select [l[i + 1] for i in range(len(l)) if (m >> i) & 1 = 1] as side, l from v, (select unnest(range(0, 1 << (select len(l) from v))) as m))"


@query("graph_max_flow", f"with {_REGIONS}{_SETS} select min(c)::double as flow from (select (select coalesce(sum(value), 0) from flow where list_contains(side, src) and not list_contains(side, dst)) as c from cuts where list_contains(side, l[1]) and not list_contains(side, l[-1]))")
def _(t):
    g = _regions(t)
    ends = g.vertices.agg(F.min("id"), F.max("id")).first()
    return t.spark.createDataFrame([(float(gr.max_flow(g, *ends)),)], "flow double")


@query("graph_min_cut", f"with {_REGIONS}{_SETS}, c as (select side, l[1] as component, (select sum(value) from flow where src < dst and list_contains(side, src) <> list_contains(side, dst)) as w from (select side, l from cuts where len(side) > 0 and not list_contains(side, l[1]))) select component, w::double as weight, array_to_string(side, ',') as side from c where w = (select min(w) from c)".replace("src < dst and list_contains", "list_contains"))
def _(t):
    g = _regions(t)
    both = g.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("value").alias("value"))
    return gr.min_cut(Graph.of(both, g.vertices, directed=False)).select("component", "weight", F.array_join(F.transform("side", lambda v: v.cast("string")), ",").alias("side"))


_STRONG = "strong as (select src, dst from net where value > (select avg(value) * 1.3 from net)), n as (select src as a, dst as b from strong union select dst, src from strong)"


@query("graph_cliques", f"with recursive {_NET}, {_IDS}, {_STRONG}, c(members, last) as (select [id], id from ids union all select list_append(members, n.b), n.b from c join n on n.a = c.last and n.b > c.last where len([m for m in members if m <> n.a]) = (select count(*) from n o where o.b = n.b and list_contains(members, o.a) and o.a <> n.a)) select array_to_string(members, ',') as members from c where not exists (select 1 from ids where not list_contains(members, id) and (select count(*) from n o where o.a = ids.id and list_contains(members, o.b)) = len(members))")
def _(t):
    g = _net(t)
    strong = g.edges.join(g.edges.agg((F.avg("value") * 1.3).alias("bar"))).where("value > bar").drop("bar")
    return gr.cliques(Graph.of(strong, g.vertices, directed=False)).select(F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"))


@query("graph_colouring", f"with recursive {_NET}, {_IDS}, o as (select id, row_number() over (order by id) as r from ids), near as (select o.r, list(distinct q.r) filter (where q.r < o.r) as l from o left join (select src as a, dst as b from net union select dst, src from net) e on e.a = o.id left join o q on q.id = e.b group by 1),"
 " s(r, colours) as (select cast(0 as bigint), [-1]::bigint[] union all select near.r, list_append(colours, list_min([x for x in range(0, near.r) if not list_contains([colours[q + 1] for q in coalesce(near.l, [])], x)])) from s join near on near.r = s.r + 1) select id, s.colours[o.r + 1] as colour from o, s where s.r = (select max(r) from o)")
def _(t):
    g = _net(t)
    return gr.colouring(Graph.of(g.edges, g.vertices, directed=False))


@query("graph_export_dot", f"""with {_NET}, {_IDS}, v as (select id, row_number() over (order by id) - 1 as number from ids) select 0 as part, cast(0 as bigint) as number, 'digraph graph {{' as line union all select 1, number, '  ' || number || ' [label="' || id || '"];' from v
 union all select 2, row_number() over (order by src, dst) - 1, '  ' || a.number || ' -> ' || b.number || ' [label="' || value || '"];' from net join v a on a.id = src join v b on b.id = dst union all select 3, 0, '}}'""")
def _(t):
    return _net(t).dot_lines()


@query("graph_copy_guards", f"with {_NET}, {_IDS} select (select count(*) from net) as edges, (select count(*) from ids) as vertices, cast(0 as bigint) as copied_empty, true as undirected_refused, true as negative_refused")
def _(t):
    g = _net(t)
    same, bare = g.copy(), g.copy(empty=True)

    def refused(call) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    checks = (refused(lambda: gr.topological(Graph.of(g.edges, directed=False))), refused(lambda: gr.shortest_paths(g, g.vertices, -F.col("value"))))
    counts = same.edges.agg(F.count("*").alias("edges")).crossJoin(same.vertices.agg(F.count("*").alias("vertices"))).crossJoin(bare.edges.agg(F.count("*").alias("copied_empty")))
    return counts.select("*", *[F.lit(v).alias(n) for v, n in zip(checks, ("undirected_refused", "negative_refused"))])
