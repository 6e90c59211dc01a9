"""Pairs that share many crowded signatures are compared once or few times."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.jaccard_join import BEFORE, CELLS, _compare

SHARED = 40


def test_a_pair_leaves_one_row_however_many_signatures_it_shares(spark):
    nodes = spark.range(1, 31).select(F.col("id").alias("node"))
    rows = nodes.crossJoin(spark.range(1, SHARED + 1).select(F.col("id").alias("g")))
    before = {f"before{i}": F.greatest(F.col("g") - i, F.lit(0)) for i in range(1, BEFORE + 1)}
    rows = rows.withColumns({"piece": F.col("g"), "block": F.lit(0), "asks": F.lit(True), "member": F.lit(True), "size": F.lit(90).cast("long"), "label": F.col("node"), "cells": F.lit(bytes(CELLS)), **before})
    pairs = _compare(rows)
    assert pairs.distinct().count() == 30 * 29 // 2
    assert pairs.count() == 30 * 29 // 2  # was once per shared signature: 40 times as many


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    ring = [(i, 200 + (i - 199) % 9) for i in range(200, 209)]
    got = {r.node: r.label for r in components(spark.createDataFrame([*chain, *ring, (1, 2), (1, 3), (9, 9)], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 209)}, 1: 1, 2: 1, 3: 1}
