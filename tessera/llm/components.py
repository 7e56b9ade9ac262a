"""Connected components over distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, materialise


def _hang(pairs: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours, re-linked to the smallest of them and the node itself.

    The minimum is a partial aggregate and the neighbours meet it in a join, so
    a node with very many neighbours is not gathered in one task: the engine may
    split the join's large side.
    """
    ways = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
    low = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    met = ways.join(low, F.col("a") == F.col("k"))
    if both:  # only neighbours above the node move
        return met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable by ``links`` (a, b), for every linked node.

    Alternates two re-linkings until every node hangs on the smallest of its
    component; the number of rounds grows with the logarithm of the longest
    path.  Each round is written to the shared folder, which cuts the lineage.
    Links may repeat, point either way or join a node to itself; nulls link nothing.
    """
    pairs = materialise(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # Done when each node has one link, and what it links to has none.
        forked = pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = pairs.join(pairs.select(F.col("a").alias("k")), F.col("b") == F.col("k"), "left_semi").select("a")
        if not forked.unionAll(chained).take(1):
            break
        up = _hang(pairs, True).distinct()
        after = materialise(_hang(up, False).distinct())
        discard(pairs)
        pairs = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select("b", F.col("b")).distinct())
