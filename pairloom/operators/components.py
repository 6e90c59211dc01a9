"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.session import written


def _least_neighbour(links: DataFrame, larger_only: bool) -> DataFrame:
    """One half round: every row's neighbours are linked to the least of them and itself."""
    both = links if larger_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least"))
    least = least.withColumn("_least", F.least("a", "_least"))
    moved = both.join(least, "a")
    if larger_only:
        # Smaller neighbours, and the row itself, go to the least one.
        pairs = moved.select(F.col("b").alias("x"), "_least").unionByName(least.select(F.col("a").alias("x"), "_least"))
    else:
        pairs = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "_least")
    return pairs.filter(F.col("x") != F.col("_least")).select(F.col("x").alias("a"), F.col("_least").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id`` for every id that has a link: the least id it can reach.

    Large and small stars in turn, a written table per round; the number of rounds grows
    with the logarithm of the longest chain. An id with very many links is counted in
    parts before it moves; its links themselves come back by a join whose skew Spark
    splits, and after the first rounds only stars are left.
    """
    ends = links.select(F.least(F.col(a), F.col(b)).alias("_lo"), F.greatest(F.col(a), F.col(b)).alias("_hi")).filter("_lo <> _hi")
    stars = written(ends.select(F.col("_hi").alias("a"), F.col("_lo").alias("b")).distinct(), "links")
    before = None
    while True:
        stars = written(_least_neighbour(_least_neighbour(stars, False), True), "stars")
        # The stars are settled when no round changes them; their sums tell.
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
