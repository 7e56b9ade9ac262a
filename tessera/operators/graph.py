"""Graphs as DataFrames: vertices (id) and edges (src, dst, value).

An undirected graph stores each edge both ways.  A pair of vertices has one edge
at most.  Iterative algorithms are loops of joins over the edges; every round is
checkpointed, so plans stay short and a lost executor costs one round.
Algorithms that are sequential by definition (depth-first orders, flows, cuts,
greedy colours, cliques) run in Python for each weakly connected component, in
parallel over components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.checks import non_negative, positive
from tessera.plans.order import global_index
from tessera.plans.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to spark.checkpoint.dir, which all executors share (set here only where it is unset)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    # -- building ------------------------------------------------------------------

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """From src, dst (and value, 1 if absent); the last of repeated pairs stays, in the order of `ord` if there."""
        if "value" not in edges.columns:
            edges = edges.withColumn("value", F.lit(1).cast("long"))
        if not directed:
            back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
            edges = edges.unionByName(back)
        last = F.max_by("value", "ord") if "ord" in edges.columns else F.max("value")
        unique = edges.groupBy("src", "dst").agg(last.alias("value"))
        ends = unique.select(F.col("src").alias("id")).union(unique.select("dst"))
        ids = (ends.union(vertices.select("id")) if vertices is not None else ends).distinct()
        return Graph(ids, unique, directed)

    def add_vertices(self, ids: DataFrame) -> Graph:
        return Graph(self.vertices.union(ids.select("id")).distinct(), self.edges, self.directed)

    def add_edges(self, edges: DataFrame) -> Graph:
        """New edges take the place of old ones between the same vertices."""
        new = Graph.of(edges, directed=self.directed)
        kept = self.edges.join(new.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        return Graph(self.vertices.union(new.vertices).distinct(), kept.unionByName(new.edges), self.directed)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select("id")
        kept = self.edges.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), kept, self.directed)

    def remove_edges(self, edges: DataFrame) -> Graph:
        gone = edges.select("src", "dst")
        if not self.directed:
            gone = gone.union(edges.select("dst", "src"))
        return Graph(self.vertices, self.edges.join(gone, ["src", "dst"], "left_anti"), self.directed)

    # -- lookups -------------------------------------------------------------------

    def successors(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.edges, F.col("id") == F.col("src")).select("id", F.col("dst").alias("other"), "value")

    def predecessors(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.edges, F.col("id") == F.col("dst")).select("id", F.col("src").alias("other"), "value")

    def neighbours(self, ids: DataFrame) -> DataFrame:
        """Distinct others on either end."""
        return self.successors(ids).select("id", "other").union(self.predecessors(ids).select("id", "other")).distinct()

    def degrees(self) -> DataFrame:
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        inn = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        both = self.vertices.join(out, "id", "left").join(inn, "id", "left")
        return both.select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))

    # -- views ---------------------------------------------------------------------

    def reversed(self) -> Graph:
        swap = {"src": "dst", "dst": "src"}
        return Graph(self.vertices, self.edges.select(*[F.col(swap.get(c, c)).alias(c) for c in self.edges.columns]), self.directed)

    def where(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """The part whose vertices and edges pass; edges of vertices that do not are gone."""
        out = self
        if vertex is not None:
            out = out.remove_vertices(self.vertices.where(~F.coalesce(vertex, F.lit(False))))
        return Graph(out.vertices, out.edges.where(edge) if edge is not None else out.edges, self.directed)

    def map(self, vertex=None, value=None) -> Graph:
        """Other ids and values by functions of columns; vertices that become equal merge."""
        v = vertex or (lambda c: c)
        edges = self.edges.select(v(F.col("src")).alias("src"), v(F.col("dst")).alias("dst"), (value(F.col("value")) if value else F.col("value")).alias("value"))
        return Graph(self.vertices.select(v(F.col("id")).alias("id")).distinct(), edges.groupBy("src", "dst").agg(F.max("value").alias("value")), self.directed)

    def copy(self, empty: bool = False) -> Graph:
        return Graph(self.vertices.limit(0), self.edges.limit(0), self.directed) if empty else self

    # -- set operations ------------------------------------------------------------

    def union(self, other: Graph, merge=None) -> Graph:
        """Edges of both; merge(mine, theirs) where both have one, theirs by default."""
        a, b = self.edges.withColumnRenamed("value", "va"), other.edges.withColumnRenamed("value", "vb")
        both = a.join(b, ["src", "dst"], "full")
        merged = (merge or (lambda x, y: y))(F.col("va"), F.col("vb"))
        value = F.when(F.col("va").isNull(), F.col("vb")).when(F.col("vb").isNull(), F.col("va")).otherwise(merged)
        return Graph(self.vertices.union(other.vertices).distinct(), both.select("src", "dst", value.alias("value")), self.directed)

    def intersection(self, other: Graph, same=None, merge=None) -> Graph:
        """Vertices and edges in both, whose values agree by ``same``; merge(mine, theirs), theirs by default."""
        both = self.edges.withColumnRenamed("value", "va").join(other.edges.withColumnRenamed("value", "vb"), ["src", "dst"])
        both = both.where(same(F.col("va"), F.col("vb"))) if same else both
        return Graph(self.vertices.join(other.vertices, "id", "left_semi"), both.select("src", "dst", (merge or (lambda x, y: y))(F.col("va"), F.col("vb")).alias("value")), self.directed)

    def complement(self, self_loops: bool = False) -> Graph:
        """All pairs without an edge: as many rows as that is, by the operation's own nature."""
        pairs = self.vertices.select(F.col("id").alias("src")).crossJoin(self.vertices.select(F.col("id").alias("dst")))
        pairs = pairs if self_loops else pairs.where("src <> dst")
        return Graph(self.vertices, pairs.join(self.edges, ["src", "dst"], "left_anti").withColumn("value", F.lit(1).cast("long")), self.directed)

    def dot_lines(self, name: str = "graph") -> DataFrame:
        """part, number, line of GraphViz text, to be put in that order: head, vertices in order, edges (undirected ones once), foot."""
        spark = self.vertices.sparkSession
        one = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("number"), F.lit(text).alias("line"))
        placed = global_index(self.vertices.select("id"), "id", "number").withColumn("number", F.col("number").cast("long"))
        label = F.replace(F.col("id").cast("string"), F.lit('"'), F.lit('\\"'))
        vertices = placed.select(F.lit(1).alias("part"), "number", F.concat(F.lit("  "), "number", F.lit(' [label="'), label, F.lit('"];')).alias("line"))
        edges = self.edges if self.directed else self.edges.where("src <= dst")
        known = global_index(edges, ["src", "dst"], "number").join(placed.select(F.col("id").alias("src"), F.col("number").alias("a")), "src").join(placed.select(F.col("id").alias("dst"), F.col("number").alias("b")), "dst")
        arrow = " -> " if self.directed else " -- "
        drawn = known.select(F.lit(2).alias("part"), F.col("number").cast("long").alias("number"), F.concat(F.lit("  "), "a", F.lit(arrow), "b", F.lit(' [label="'), F.col("value").cast("string"), F.lit('"];')).alias("line"))
        return one(0, f"{'digraph' if self.directed else 'graph'} {name} {{").unionAll(vertices).unionAll(drawn).unionAll(one(3, "}"))

    def write_dot(self, folder: str, name: str = "graph") -> None:
        """The lines as text files whose names are in their order."""
        self.dot_lines(name).repartitionByRange("part", "number").sortWithinPartitions("part", "number").select("line").write.text(folder)

    def to_dot(self, name: str = "graph", most: int = 200_000) -> str:
        """GraphViz text of a graph that fits the driver: more than ``most`` lines are an error (see `write_dot`)."""
        lines = self.dot_lines(name).orderBy("part", "number").limit(most + 1).collect()
        if len(lines) > most:
            raise ValueError(f"more than {most} lines: use write_dot")
        return "\n".join(r["line"] for r in lines)


# -- factories ----------------------------------------------------------------------


def _numbered(spark: SparkSession, n: int, edges: DataFrame, directed: bool) -> Graph:
    return Graph.of(edges.select("src", "dst"), spark.range(n), directed)


def empty(spark: SparkSession, n: int) -> Graph:
    return _numbered(spark, non_negative(n, "n"), spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")), True)


def path(spark: SparkSession, n: int, directed: bool = True) -> Graph:
    return _numbered(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), directed)


def ring(spark: SparkSession, n: int, directed: bool = True) -> Graph:
    return _numbered(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")), directed)


def star(spark: SparkSession, n: int, directed: bool = True) -> Graph:
    return _numbered(spark, n, spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), directed)


def complete(spark: SparkSession, n: int, directed: bool = True) -> Graph:
    ids = spark.range(n)
    return _numbered(spark, n, ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst"))).where("src <> dst"), directed)


def partite(spark: SparkSession, counts: list[int], directed: bool = True) -> Graph:
    """Parts of the given sizes; every vertex has an edge to every one of a later part."""
    starts = [sum(counts[:k]) for k in range(len(counts) + 1)]
    part = F.lit(0)
    for k, s in enumerate(starts[:-1]):
        part = F.when(F.col("id") >= s, F.lit(k)).otherwise(part)
    ids = spark.range(starts[-1]).withColumn("p", part)
    pairs = ids.select(F.col("id").alias("src"), F.col("p").alias("p1")).crossJoin(ids.select(F.col("id").alias("dst"), F.col("p").alias("p2"))).where("p1 < p2")
    return _numbered(spark, starts[-1], pairs, directed)


def complete_tree(spark: SparkSession, n: int, arity: int = 2, directed: bool = True) -> Graph:
    positive(arity, "arity")
    return _numbered(spark, n, spark.range(1, max(1, n)).select(F.floor((F.col("id") - 1) / arity).cast("long").alias("src"), F.col("id").alias("dst")), directed)


def perfect_tree(spark: SparkSession, height: int, arity: int = 2, directed: bool = True) -> Graph:
    return complete_tree(spark, sum(arity**k for k in range(height + 1)), arity, directed)


def random_graph(spark: SparkSession, n: int, probability: float, seed: int = 0, directed: bool = True) -> Graph:
    """Every pair has an edge with the same probability.

    Each vertex skips from one edge to its next by geometric distances, so the
    work follows the edges that come out and not the pairs.
    """
    if not 0 <= probability <= 1:
        raise ValueError("probability must be from 0 to 1")

    def draw(batches):
        for batch in batches:
            for v in batch["id"]:
                rng, first = np.random.default_rng([seed, v]), 0 if directed else v + 1
                others, at = [], first - 1
                while probability > 0:
                    room = n - 1 - at
                    steps = np.cumsum(rng.geometric(probability, max(16, int(room * probability * 1.2) + 16)))
                    kept = steps[steps <= room]
                    others.append(at + kept)
                    if len(kept) < len(steps):
                        break
                    at += int(kept[-1])
                found = np.concatenate(others) if others else np.empty(0, np.int64)
                yield pd.DataFrame({"src": np.int64(v), "dst": found[found != v].astype(np.int64)})

    return _numbered(spark, n, spark.range(non_negative(n, "n")).mapInPandas(draw, "src long, dst long"), directed)


# -- iterative algorithms -------------------------------------------------------------


def breadth_first(g: Graph, starts: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth of everything reachable from the starts, themselves at 0.

    A round a step; more than ``most`` (as many as there are vertices, if not given) are an error.
    """
    most = g.vertices.count() + 1 if most is None else most
    seen = checkpointed(starts.select("id").distinct().withColumn("depth", F.lit(0).cast("long")))
    frontier = seen
    for depth in range(1, most + 1):
        step = g.successors(frontier).select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpointed(step.withColumn("depth", F.lit(depth).cast("long")))
        if not frontier.take(1):
            return seen
        seen = checkpointed(seen.unionAll(frontier))
    raise RuntimeError(f"more than {most} steps deep")


def _hooked(pairs: DataFrame, up: bool) -> DataFrame:
    """Pairs (a, b) with b below a, re-linked: with ``up`` what is above a vertex to the smallest that it touches, else each to its own smallest."""
    touching = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if up else pairs
    low = touching.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    moved = touching.join(low, F.col("a") == F.col("k"))
    if up:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected(g: Graph, most: int = 60) -> DataFrame:
    """id, component: the smallest id connected by edges in either direction; a vertex alone is its own.

    Edges are re-linked towards smaller ids, first from a vertex's neighbours
    and then from the vertex, until all hang on the smallest.  The rounds grow
    with the logarithm of the longest path, and only minima are gathered by
    vertex, so a giant component is no hot key.
    """
    pairs = checkpointed(g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    for _ in range(most):
        forked = pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = pairs.join(pairs.select(F.col("a").alias("k")), F.col("b") == F.col("k"), "left_semi").select("a")
        if not forked.unionAll(chained).take(1):
            return g.vertices.join(pairs, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
        pairs = checkpointed(_hooked(_hooked(pairs, True), False))
    raise RuntimeError(f"components did not settle in {most} rounds")


def topological(g: Graph, most: int = 100_000) -> DataFrame:
    """id, layer of the vertices that no cycle reaches: each after all its predecessors."""
    if not g.directed:
        raise ValueError("a topological order needs a directed graph")
    left, edges, done = checkpointed(g.vertices.select("id")), checkpointed(g.edges.select("src", "dst")), None
    for layer in range(most):
        free = left.join(edges, F.col("id") == F.col("dst"), "left_anti")
        free = checkpointed(free.withColumn("layer", F.lit(layer).cast("long")))
        if not free.take(1):
            return done if done is not None else free
        done = free if done is None else done.unionAll(free)
        left = checkpointed(left.join(free, "id", "left_anti"))
        edges = checkpointed(edges.join(free, F.col("src") == F.col("id"), "left_anti"))
    raise RuntimeError(f"more than {most} layers")


def cyclic(g: Graph) -> DataFrame:
    """cyclic, in one row: whether a directed cycle exists, which is what cannot be put in topological order."""
    return g.vertices.join(topological(g), "id", "left_anti").agg((F.count("*") > 0).alias("cyclic"))


def has_cycle(g: Graph) -> bool:
    return cyclic(g).first()[0]


def bipartite(g: Graph) -> DataFrame:
    """bipartite, in one row: whether two colours do, edges read in both directions."""
    both = g.edges.select("src", "dst").union(g.edges.select("dst", "src")).distinct()
    # A double cover: each vertex twice, edges across. Bipartite if no vertex meets its twin.
    ids = g.vertices.select(F.struct(F.col("id").alias("v"), F.lit(0).alias("s")).alias("id")).union(g.vertices.select(F.struct(F.col("id").alias("v"), F.lit(1).alias("s")).alias("id")))
    cross = both.select(F.struct(F.col("src").alias("v"), F.lit(0).alias("s")).alias("src"), F.struct(F.col("dst").alias("v"), F.lit(1).alias("s")).alias("dst"))
    found = connected(Graph(ids, cross.union(cross.select("dst", "src"))))
    twins = found.groupBy("id.v", "component").agg(F.count("*").alias("n"))
    return twins.where("n > 1").agg((F.count("*") == 0).alias("bipartite"))


def is_bipartite(g: Graph) -> bool:
    return bipartite(g).first()[0]


def shortest_paths(g: Graph, starts: DataFrame, cost: Column | None = None, negative: bool = False, targets: DataFrame | None = None, heuristic: Column | None = None, most: int = 100_000) -> DataFrame:
    """id, cost, parent: the smallest cost from any start (0 with no parent), for what is reachable.

    Rounds of relaxation from the vertices that improved.  A negative cost is an
    error unless ``negative`` is set; then a negative cycle is one.  With targets
    the loop ends once all are settled.  A ``heuristic`` of ``id``, never above the
    cost that is left to a target, keeps vertices out of the search that cannot
    better a target's cost; what it leaves out may be missing or cost too much.
    """
    if heuristic is not None and (targets is None or negative):
        raise ValueError("a heuristic needs targets and costs that are not negative")
    weighted = g.edges.select("src", "dst", (cost if cost is not None else F.col("value")).cast("double").alias("w"))
    if not negative and weighted.where("w < 0").take(1):
        raise ValueError("negative edge costs: set negative=True")
    weighted = checkpointed(weighted)
    n = g.vertices.count()
    best = checkpointed(starts.select("id").distinct().select("id", F.lit(0.0).alias("cost"), F.lit(None).cast(dict(g.vertices.dtypes)["id"]).alias("parent")))
    frontier = best
    for step in range(most):
        if negative and step > n:
            raise ValueError("a cycle of negative cost")
        offers = frontier.join(weighted, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("c"), F.col("src").alias("p"))).alias("o"))
        met = best.join(offers, F.col("id") == F.col("dst"), "full")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.c") < F.col("cost")))
        after = checkpointed(met.select(F.coalesce("id", "dst").alias("id"), F.when(better, F.col("o.c")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("o.p")).otherwise(F.col("parent")).alias("parent"), better.alias("new")))
        frontier, best = after.where("new").drop("new"), after.drop("new")
        if not frontier.take(1):
            return best
        if targets is not None and not negative:
            worst = best.join(targets.select("id"), "id", "right").agg(F.max("cost").alias("w"), F.count_if(F.col("cost").isNull()).alias("open")).first()
            if not worst["open"]:
                ahead = F.col("cost") + heuristic.cast("double") if heuristic is not None else F.col("cost")
                frontier = checkpointed(frontier.where(ahead < F.lit(worst["w"] or 0.0)))
                if not frontier.take(1):
                    return best
    raise RuntimeError(f"paths did not settle in {most} rounds")


def path_to(paths: DataFrame, targets: DataFrame, most: int = 100_000) -> DataFrame:
    """target, back, id, cost of the vertices on a way from a start to each target: back counts from the target, 0.

    Parents are followed by a join a step, for all targets together; one that was not reached has no row.
    """
    at = checkpointed(paths.join(targets.select(F.col("id").alias("target")).distinct(), F.col("id") == F.col("target")).select("target", F.lit(0).cast("long").alias("back"), "id", "cost", "parent"))
    out = at
    for back in range(1, most):
        up = at.where("parent is not null").select("target", F.col("parent").alias("_up"))
        at = checkpointed(up.join(paths, F.col("_up") == F.col("id")).select("target", F.lit(back).cast("long").alias("back"), "id", "cost", "parent"))
        if not at.take(1):
            return out.drop("parent")
        out = out.unionAll(at)
    raise RuntimeError("the path does not end")


def all_paths_to(g: Graph, paths: DataFrame, target: DataFrame, cost: Column | None = None, most: int = 100_000) -> DataFrame:
    """route: every one of the shortest ways from a start to the target, as an array of vertices; as many rows as there are such ways."""
    tight = checkpointed(tight_edges(g, paths, cost))
    starts = paths.where("parent is null").select(F.col("id").alias("s"))
    at = checkpointed(paths.join(target.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left_semi").select("id", F.array("id").alias("route")))
    out = at.join(starts, F.col("id") == F.col("s"), "left_semi").select("route")
    for _ in range(most):
        at = checkpointed(at.join(tight, F.col("id") == F.col("dst")).where(~F.array_contains("route", F.col("src"))).select(F.col("src").alias("id"), F.concat(F.array("src"), "route").alias("route")))
        if not at.take(1):
            return out
        out = out.unionAll(at.join(starts, F.col("id") == F.col("s"), "left_semi").select("route"))
    raise RuntimeError("the paths do not end")


def tight_edges(g: Graph, paths: DataFrame, cost: Column | None = None) -> DataFrame:
    """src, dst of the edges on any of the shortest paths: all of these, traced back, are all the paths."""
    a, b = paths.select(F.col("id").alias("src"), F.col("cost").alias("ca")), paths.select(F.col("id").alias("dst"), F.col("cost").alias("cb"))
    w = (cost if cost is not None else F.col("value")).cast("double")
    return g.edges.withColumn("_w", w).join(a, "src").join(b, "dst").where(F.abs(F.col("ca") + F.col("_w") - F.col("cb")) <= 1e-9).select("src", "dst")


def all_pairs(g: Graph, cost: Column | None = None) -> DataFrame:
    """src, dst, cost for each pair with a path (a vertex to itself 0), by min-plus squaring.  A negative cycle is an error."""
    w = (cost if cost is not None else F.col("value")).cast("double")
    base = g.edges.select("src", "dst", w.alias("cost")).unionAll(g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost")))
    now = checkpointed(base.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    for _ in range(max(1, g.vertices.count()).bit_length() + 1):
        left, right = now.select("src", F.col("dst").alias("mid"), F.col("cost").alias("c1")), now.select(F.col("src").alias("mid"), "dst", F.col("cost").alias("c2"))
        after = checkpointed(left.join(right, "mid").groupBy("src", "dst").agg(F.min(F.col("c1") + F.col("c2")).alias("cost")))
        if after.where("src = dst and cost < 0").take(1):
            raise ValueError("a cycle of negative cost")
        if not after.join(now.select("src", "dst", F.col("cost").alias("old")), ["src", "dst"], "left").where("old is null or cost < old").take(1):
            return after
        now = after
    return now


def spanning_forest(g: Graph, weight: Column | None = None, largest: bool = False, most: int = 60) -> DataFrame:
    """src, dst, value of a minimum (or maximum) spanning forest, by Borůvka's rounds.

    Ties are broken by the ends, so the edges are in a total order and no round
    can close a cycle.
    """
    w = (weight if weight is not None else F.col("value")).cast("double")
    edges = g.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (-w if largest else w).alias("w"), "value")
    edges = checkpointed(edges.groupBy("u", "v").agg(F.min(F.struct("w", "value")).alias("e")).select("u", "v", "e.w", "e.value"))
    label, chosen = checkpointed(g.vertices.select("id", F.col("id").alias("c"))), None
    for _ in range(most):
        placed = edges.join(label.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(label.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv")
        key = F.struct("w", "u", "v", "value")
        ways = placed.select(F.col("cu").alias("c"), key.alias("k")).union(placed.select(F.col("cv").alias("c"), key.alias("k")))
        best = checkpointed(ways.groupBy("c").agg(F.min("k").alias("k")).select("k.u", "k.v", "k.w", "k.value").distinct())
        if not best.take(1):
            break
        chosen = best if chosen is None else checkpointed(chosen.unionAll(best).distinct())
        tree = chosen.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1).alias("value"))
        label = connected(Graph(g.vertices, tree)).select("id", F.col("component").alias("c"))
    if chosen is None:
        return edges.limit(0).select(F.col("u").alias("src"), F.col("v").alias("dst"), "value")
    return chosen.select(F.col("u").alias("src"), F.col("v").alias("dst"), "value")


def spanning_tree_from(g: Graph, start, weight: Column | None = None, largest: bool = False) -> DataFrame:
    """The spanning tree of the component that holds the start."""
    label = connected(g)
    mine = label.join(label.where(F.col("id") == F.lit(start)).select("component"), "component").select("id")
    part = Graph(mine, g.edges.join(mine, F.col("src") == F.col("id"), "left_semi"), g.directed)
    return spanning_forest(part, weight, largest)


def strongly_connected(g: Graph, most: int | None = None) -> DataFrame:
    """id, component (its smallest id), by colouring.

    Every vertex takes the largest id that reaches it; those of a colour that
    reach back to its vertex are a component, and leave.  Colours spread a step
    a round; more rounds than ``most`` (as many as there are vertices, if not
    given, which always do) are an error.
    """
    if not g.directed:
        raise ValueError("strong components need a directed graph")
    most = max(1, g.vertices.count()) if most is None else most
    left, edges, done = checkpointed(g.vertices.select("id")), checkpointed(g.edges.select("src", "dst").where("src <> dst")), None
    for _ in range(most):
        # What nothing reaches, or what reaches nothing, is a component of its own: chains need no colours.
        both = edges.select(F.col("src").alias("id")).intersect(edges.select("dst"))
        alone = left.join(both, "id", "left_anti").select("id", F.col("id").alias("component"))
        done = checkpointed(alone if done is None else done.unionAll(alone))
        left = checkpointed(left.join(both, "id", "left_semi"))
        if not left.take(1):
            return done
        edges = checkpointed(edges.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi"))
        colour = checkpointed(left.select("id", F.col("id").alias("c")))
        for _ in range(most):
            offers = edges.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("o"))
            after = checkpointed(colour.join(offers, F.col("id") == F.col("dst"), "left").select("id", F.col("c").alias("old"), F.greatest("c", F.coalesce("o", "c")).alias("c")))
            changed = after.where("old <> c").take(1)
            colour = after.select("id", "c")
            if not changed:
                break
        else:
            raise RuntimeError(f"colours did not settle in {most} rounds")
        same = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2")
        back = checkpointed(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("c1").alias("value")))
        found = breadth_first(Graph(left, back), colour.where("id = c"))
        part = checkpointed(found.select("id").join(colour, "id"))
        named = part.join(part.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component")
        done = checkpointed(named if done is None else done.unionAll(named))
        left = checkpointed(left.join(part, "id", "left_anti"))
        if not left.take(1):
            return done
        edges = checkpointed(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    raise RuntimeError("strong components did not settle")


#: Edges of a graph that an algorithm on the driver takes.
MOST_ON_DRIVER = 1_000_000

# -- for each component, in Python --------------------------------------------------------


def per_component(g: Graph, run, schema: str) -> DataFrame:
    """run(vertices, [(src, dst, value)]) -> rows, for each weakly connected component in parallel; components must fit a task."""
    label = connected(g)
    names = [f.split()[0] for f in schema.split(", ")]
    kind = dict(g.vertices.dtypes)["id"]
    value = dict(g.edges.dtypes)["value"]
    edges = g.edges.join(label, F.col("src") == F.col("id")).select("component", "src", "dst", "value")
    alone = label.select("component", F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast(value).alias("value"))

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        vertices = sorted(pdf["src"].unique())
        own = [(a, b, v) for a, b, v in zip(pdf["src"], pdf["dst"], pdf["value"]) if not pd.isna(b)]
        own = [(a, type(a)(b), v) for a, b, v in own]
        return pd.DataFrame(run(vertices, sorted(own)), columns=names)

    return edges.unionByName(alone).groupBy("component").applyInPandas(grouped, schema)


def _adjacent(edges) -> dict:
    out: dict = {}
    for a, b, v in edges:
        out.setdefault(a, {})[b] = v
    return out


def depth_first(g: Graph, post: bool = False) -> DataFrame:
    """id, start, place: a depth-first order of each component from its smallest vertex on, neighbours rising."""
    kind = dict(g.vertices.dtypes)["id"]

    def run(vertices, edges):
        near, seen, out = _adjacent(edges), set(), []
        for start in vertices:
            if start in seen:
                continue
            seen.add(start)
            if not post:
                out.append(start)
            stack = [(start, iter(sorted(near.get(start, ()))))]
            while stack:
                v, others = stack[-1]
                for o in others:
                    if o not in seen:
                        seen.add(o)
                        if not post:
                            out.append(o)
                        stack.append((o, iter(sorted(near.get(o, ())))))
                        break
                else:
                    stack.pop()
                    if post:
                        out.append(v)
        return [(v, vertices[0], i) for i, v in enumerate(out)]

    return per_component(g, run, f"id {kind}, start {kind}, place long")


def random_walk(g: Graph, starts: DataFrame, steps: int, seed: int = 0, self_avoiding: bool = False) -> DataFrame:
    """start, step, id: a walk from each start, edges chosen in proportion to their values."""
    walk = starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("step"), "id", F.array("id").alias("been"))
    walk = now = checkpointed(walk)
    for k in range(1, steps + 1):
        options = now.join(g.edges, F.col("id") == F.col("src"))
        options = options.where(~F.array_contains("been", F.col("dst"))) if self_avoiding else options
        # The smallest of exponential clocks rings first with a probability in proportion to its rate.
        u = (F.pmod(F.xxhash64("start", "dst", F.lit(seed * 1_000_003 + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        picked = options.groupBy("start").agg(F.min_by(F.struct("dst", "been"), -F.log(u) / F.col("value")).alias("x"))
        now = checkpointed(picked.select("start", F.lit(k).cast("long").alias("step"), F.col("x.dst").alias("id"), F.concat("x.been", F.array("x.dst")).alias("been")))
        walk = walk.unionAll(now)
        if not now.take(1):
            break
    return walk.select("start", "step", "id")


def max_flow(g: Graph, source, sink) -> float:
    """The largest flow, by blocking flows over level graphs; on the driver, for graphs that fit it: more than MOST_ON_DRIVER edges are an error."""
    from collections import deque

    cap: dict = {}
    edges = g.edges.limit(MOST_ON_DRIVER + 1).collect()
    if len(edges) > MOST_ON_DRIVER:
        raise ValueError(f"more than {MOST_ON_DRIVER} edges")
    for e in edges:
        cap.setdefault(e["src"], {})
        cap.setdefault(e["dst"], {})
        cap[e["src"]][e["dst"]] = cap[e["src"]].get(e["dst"], 0) + e["value"]
        cap[e["dst"]].setdefault(e["src"], 0)
    total = 0
    while source in cap and sink in cap and source != sink:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for o, c in cap[v].items():
                if c > 0 and o not in level:
                    level[o] = level[v] + 1
                    queue.append(o)
        if sink not in level:
            break
        todo = {v: list(cap[v]) for v in cap}
        while True:
            route, v = [], source
            while v != sink:
                while todo[v] and not (cap[v][todo[v][-1]] > 0 and level.get(todo[v][-1]) == level[v] + 1):
                    todo[v].pop()
                if todo[v]:
                    route.append((v, todo[v][-1]))
                    v = todo[v][-1]
                elif route:
                    v, _ = route.pop()
                    todo[v].pop()
                else:
                    break
            if v != sink:
                break
            push = min(cap[a][b] for a, b in route)
            for a, b in route:
                cap[a][b] -= push
                cap[b][a] += push
            total += push
    return total


def min_cut(g: Graph) -> DataFrame:
    """component, weight, side: a smallest cut of each component of an undirected graph, as the vertices that it parts from the smallest; null for single vertices."""
    kind = dict(g.vertices.dtypes)["id"]

    def run(vertices, edges):
        weight = {v: {} for v in vertices}
        for a, b, v in edges:
            if a != b:
                weight[a][b] = float(v)
        merged, best = {v: [v] for v in vertices}, None
        while len(weight) > 1:
            order, near = [], {v: 0.0 for v in weight}
            while near:
                v = max(sorted(near), key=near.get)
                cut = near.pop(v)
                order.append(v)
                for o, w in weight[v].items():
                    if o in near:
                        near[o] += w
            t, s = order[-1], order[-2]
            if best is None or cut < best[0]:
                away = set(vertices) - set(merged[t]) if vertices[0] in merged[t] else merged[t]
                best = (cut, sorted(away))
            merged[s] += merged.pop(t)
            for o, w in weight.pop(t).items():
                weight[o].pop(t)
                if o != s:
                    weight[s][o] = weight[o][s] = weight[s].get(o, 0.0) + w
        return [(vertices[0], *(best or (None, None)))]

    return per_component(g, run, f"component {kind}, weight double, side array<{kind}>")


def cliques(g: Graph) -> DataFrame:
    """members: every maximal clique of an undirected graph, each found at its smallest member."""
    kind = dict(g.vertices.dtypes)["id"]

    def run(vertices, edges):
        near = {v: set() for v in vertices}
        for a, b, _ in edges:
            if a != b:
                near[a].add(b)
        out, stack = [], [(set(), set(vertices), set())]
        while stack:
            clique, more, gone = stack.pop()
            if not more and not gone:
                out.append((sorted(clique),))
                continue
            pivot = max(more | gone, key=lambda v: len(near[v] & more))
            for v in sorted(more - near[pivot]):
                stack.append((clique | {v}, more & near[v], gone & near[v]))
                more = more - {v}
                gone = gone | {v}
        return out

    return per_component(g, run, f"members array<{kind}>")


def colouring(g: Graph) -> DataFrame:
    """id, colour: each vertex in rising order takes the smallest colour that no neighbour has."""
    kind = dict(g.vertices.dtypes)["id"]

    def run(vertices, edges):
        near, colour = _adjacent(edges + [(b, a, v) for a, b, v in edges]), {}
        for v in vertices:
            taken = {colour[o] for o in near.get(v, ()) if o in colour and o != v}
            colour[v] = next(c for c in range(len(taken) + 1) if c not in taken)
        return list(colour.items())

    return per_component(g, run, f"id {kind}, colour long")
