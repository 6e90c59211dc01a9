"""Exact duplicates by a tree merge of sorted digest runs.

Every row starts in one of ``fan_in ** rounds`` nodes, chosen by its id. In each round
``fan_in`` nodes hand their runs to a common parent, which merges them: equal digests
meet, the kept identifier and the count survive. After the last round one run per digest
is left. The answers then go down the same tree, so that a text with a third of all rows
is spread over all nodes in every step and no task ever sees more than its share.

A digest is believed only together with an independent 64-bit hash and the length in
bytes, which are part of the key on every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.tables import partitions, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["_digest", "_print", "_bytes"]


def normalised(text: Column | str) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), UPPER, UPPER.lower())


def _rounds(df: DataFrame, fan_in: int) -> int:
    nodes, rounds = fan_in, 1
    while nodes < partitions(df.sparkSession):
        nodes, rounds = nodes * fan_in, rounds + 1
    return rounds


def _merge(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """One round: the sorted runs of ``fan_in`` nodes become one. The identifier is
    compared as a struct, for which Spark merges sorted rows instead of hashing."""
    best = F.max if keep == "largest" else F.min
    parent = runs.withColumn("_node", F.floor(F.col("_node") / fan_in).cast("long"))
    return parent.groupBy(*KEY, "_node").agg(best("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    fan_in: int = 8,
    rounds: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty text, so all null and empty rows form one group. Only the
    two named columns are read, so other columns may have any name. Rows that repeat an
    id with the same text count in ``group_size`` and are kept or dropped alike; a null
    id stays only where its whole group has no id. An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rounds = rounds or _rounds(docs, fan_in)
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_text")).select(
        "_id",
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        F.xxhash64("_text").alias("_print"),
        F.octet_length("_text").alias("_bytes"),
        F.pmod(F.xxhash64("_id"), F.lit(fan_in**rounds)).alias("_node"),
    )
    rows = stored(rows, "digests")

    # With "smallest", a null id must not win against a real one.
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")) if keep == "smallest" else F.struct(F.col("_id").alias("id"))
    best = F.max if keep == "largest" else F.min
    level = rows.groupBy(*KEY, "_node").agg(best(rank).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    levels = [level]
    for _ in range(rounds):
        level = _merge(level, fan_in, keep)
        levels.append(level)

    answer = levels.pop()
    while levels:
        child = levels.pop().select(*KEY, "_node").withColumn("_parent", F.floor(F.col("_node") / fan_in).cast("long"))
        answer = child.join(answer.withColumnRenamed("_node", "_parent"), [*KEY, "_parent"]).drop("_parent")
    out = rows.join(answer, [*KEY, "_node"])
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep.id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
