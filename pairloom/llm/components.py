"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them and itself: the larger
    neighbours (large star) or the smaller ones (small star). The minimum is taken in the
    map tasks first, and the join splits a hub's rows."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return linked.filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of a pair; the label is the smallest node that can be
    reached. Each round is written to the shared folder, so lineage stays short."""
    edges = stored(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        edges = stored(_star(_star(edges, large=True), large=False), "stars")
        # Every node hangs directly on one node that hangs on none: nothing is left to do.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("e"))
        hung = ends.groupBy("e.node").agg(F.sum("e.hangs").alias("n"), F.min("e.hangs").alias("least"))
        if hung.filter("n > 1 or n > least").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
