"""Connected components of a graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; equal roots are connected.

    In each round every node moves to the neighbour (or itself) with the smallest of
    the round's random priorities, edges are renamed and made distinct, and loops go.
    The rounds grow with the logarithm of the longest path, as priorities are drawn
    anew.  A hub's edges are reduced before the shuffle, and adaptive joins split them.
    Edges with a null end and loops are left out, and so are nodes without other edges.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    edges = checkpointed(edges)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    moved = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        best = F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("p"), F.col("b").alias("to")))
        nearest = both.groupBy("a").agg(best.alias("n"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("p"), F.col("a").alias("to"))
        hop = checkpointed(
            nearest.select(F.col("a").alias("at"), F.least("n", own)["to"].alias("to"))
        )
        left = hop.withColumnsRenamed({"at": "a", "to": "to_a"})
        right = hop.withColumnsRenamed({"at": "b", "to": "to_b"})
        edges = edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        edges = checkpointed(
            edges.select(
                F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
            ).distinct()
        )
        moved = moved.join(hop.withColumnRenamed("at", "root"), "root", "left")
        moved = checkpointed(moved.select("node", F.coalesce("to", "root").alias("root")))
    return moved
