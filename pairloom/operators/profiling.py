"""Dataset profiles as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import ColumnOrName, col


def numeric_profile(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Average, population deviation, minimum and maximum per measure, in one pass."""
    stats = [
        F.struct(
            F.lit(name).alias("name"),
            F.count(c).alias("n"),
            F.avg(c).alias("avg"),
            F.stddev_pop(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for name, c in measures.items()
    ]
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def distribution(
    df: DataFrame, value: ColumnOrName, default: str | None = None, order_key: str | None = None
) -> DataFrame:
    """Count and percent by value; ``first_seen`` orders equal counts.

    Arrays count each of their elements, with percent of all elements. Counting is
    combined before the shuffle, so a dominant value does not burden one task.
    """
    c = col(value)
    source = df.select(c.alias("value"), *([F.col(order_key).alias("_at")] if order_key else []))
    if source.schema["value"].dataType.typeName() == "array":
        source = source.withColumn("value", F.explode("value"))
    if default is not None:
        source = source.withColumn("value", F.coalesce("value", F.lit(default)))
    aggs = [F.count(F.lit(1)).alias("n")]
    if order_key:
        aggs.append(F.min("_at").alias("first_seen"))
    counts = source.groupBy("value").agg(*aggs)
    # The subquery uses every column of ``counts``, so it is the same plan and runs once.
    rest = [F.max(c) for c in counts.columns[2:]]
    total = counts.agg(F.struct(F.sum("n").alias("n"), *rest).alias("t")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total["n"])


def by_frequency(dist: DataFrame) -> DataFrame:
    """Most common first, equal counts by first appearance."""
    ties = ["first_seen"] if "first_seen" in dist.columns else ["value"]
    return dist.orderBy(F.desc("n"), *ties)


def bucket_counts(df: DataFrame, value: ColumnOrName, edges: Sequence[float]) -> DataFrame:
    """Rows in (-inf, e0), [e0, e1), ..., [ek, inf): counts and percent, in one pass."""
    c = col(value)
    bounds = [None, *edges, None]
    cells = []
    for lo, hi in zip(bounds, bounds[1:]):
        tests = [c >= lo] if lo is not None else []
        tests += [c < hi] if hi is not None else []
        label = f"< {hi}" if lo is None else f">= {lo}" if hi is None else f"{lo} - {hi}"
        n = F.count_if(reduce(lambda a, b: a & b, tests))
        cells.append(F.struct(F.lit(label).alias("bucket"), n.alias("n"), _percent(n).alias("pct")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _percent(n: Column) -> Column:
    return F.coalesce(F.try_divide(n * 100.0, F.count(F.lit(1))), F.lit(0.0))


def share(df: DataFrame, predicate: Column) -> DataFrame:
    n = F.count_if(predicate)
    return df.agg(n.alias("n"), _percent(n).alias("pct"))


def validate(sft: DataFrame, pref: DataFrame, target: int | None) -> DataFrame:
    """One row per check: both sides equal in count, and equal to the target."""
    counts = [d.agg(F.count(F.lit(1))).scalar() for d in (sft, pref)]
    one = sft.sparkSession.range(1).select(counts[0].alias("a"), counts[1].alias("b"))
    checks = [F.struct(F.lit("same_count").alias("check"), F.col("a").alias("expected"), F.col("b").alias("actual"))]
    if target is not None:
        checks.append(
            F.struct(F.lit("target_count").alias("check"), F.lit(target).cast("long").alias("expected"), F.col("a").alias("actual"))
        )
    rows = one.select(F.inline(F.array(*checks)))
    return rows.withColumn("ok", F.col("expected") == F.col("actual"))


def warn_small(df: DataFrame, minimum: int) -> DataFrame:
    """Check row: is the table at least this long?"""
    n = F.count(F.lit(1))
    return df.agg(
        F.lit("minimum_rows").alias("check"),
        F.lit(minimum).cast("long").alias("expected"),
        n.alias("actual"),
        (n >= minimum).alias("ok"),
    )


def dataset_profile(df: DataFrame, columns: Mapping[str, str | None]) -> DataFrame:
    """Distributions of several categorical columns from one scan.

    ``columns`` maps a column to the value that stands for a missing one. Rows are first
    counted per combination, before any shuffle, so the grouping sets expand counts and
    not rows.
    """
    names = list(columns)
    filled = [
        F.col(c).alias(c) if default is None else F.coalesce(c, F.lit(default)).alias(c)
        for c, default in columns.items()
    ]
    cells = df.select(*filled).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    sets = cells.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(
        F.sum("_n").alias("n"), F.grouping_id().alias("_set")
    )
    # Bit order of grouping_id: the leftmost column is the highest; a set bit means "not grouped".
    full = (1 << len(names)) - 1
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(names):
        here = F.col("_set") == (full ^ (1 << (len(names) - 1 - i)))
        dimension = F.when(here, c).otherwise(dimension)
        value = F.when(here, F.col(c).cast("string")).otherwise(value)
    total = cells.agg(F.sum("_n")).scalar()
    return sets.select(
        dimension.alias("dimension"), value.alias("value"), "n", (F.col("n") * 100.0 / total).alias("pct")
    )
