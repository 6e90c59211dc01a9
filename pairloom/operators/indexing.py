"""Dense row numbers and exact cuts without a single-task window over the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.text import ColumnOrName, col
from pairloom.session import fresh_dir

OFFSET_BITS = 33


def require_unique(df: DataFrame, *key: str) -> None:
    """Raise where the key repeats or is null. Reads the key columns alone, counted in the
    map tasks first."""
    seen = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    missing = reduce(or_, [F.col(k).isNull() for k in key])
    if not seen.filter((F.col("_n") > 1) | missing).isEmpty():
        raise ValueError(f"the key {', '.join(key)} is not unique, or missing in some rows")


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, with an error instead of its rows where the key repeats or is missing.

    Lazy: the keys are counted over the exchange that a join on the key needs anyway, so
    the check moves no row once more.
    """
    kind = df.schema[key].dataType
    known = F.coalesce(F.col(key), F.raise_error(F.lit(f"the key {key} is missing in some rows, so it is not unique")).cast(kind))
    counted = df.withColumn(key, known).withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(key)))
    once = F.when(F.col("_times") > 1, F.raise_error(F.lit(f"the key {key} is not unique")).cast("boolean")).otherwise(True)
    return counted.filter(once).drop("_times")


def _placed(df: DataFrame, order_by: Sequence[ColumnOrName], name: str, hold: bool) -> DataFrame:
    """``df`` sorted and written once, with the number of each row and of its partition.

    The place of a row is written with it, so the numbers do not depend on how the table
    is split when it is read.
    """
    hold = hold and df.storageLevel == StorageLevel.NONE  # leave the caller's own cache alone
    if hold:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    path = fresh_dir(df.sparkSession, "sorted")
    df.orderBy(*[col(c) for c in order_by]).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    if hold:
        df.unpersist()
    place = F.col("_place")
    written = df.sparkSession.read.parquet(path).withColumns(
        {"_part": F.shiftright(place, OFFSET_BITS), "_at": place.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))}
    )
    counts = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = written.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at"))
    return numbered.select(*df.columns, "_part", name)


def with_dense_index(df: DataFrame, *order_by: ColumnOrName, name: str = "index", hold: bool = False) -> DataFrame:
    """Add 0, 1, 2, ... in the given order.

    A range-partitioned sort spreads the rows, which are written once to the shared folder
    as Parquet, and each partition adds the number of rows before it. Only one count per
    partition meets in one task. The order must be total (end with a unique column) for
    the numbers to be repeatable and for equal values to spread.

    The sort reads its input twice, once to sample the ranges. ``hold=True`` keeps the
    rows in between, for narrow rows that were dear to compute.
    """
    return _placed(df, order_by, name, hold).drop("_part")


def with_group_index(
    df: DataFrame, by: Sequence[str], *order_by: ColumnOrName, name: str = "index", hold: bool = False
) -> DataFrame:
    """Add 0, 1, 2, ... within each group, without a task per group.

    Groups and their rows are sorted together, so a large group spans many partitions; the
    number is the distance from the group's first row. That row's number comes back to the
    rows by partition and group, so no join key has more rows than a partition.
    """
    placed = _placed(df, [*by, *order_by], "_at_all", hold)
    local = placed.groupBy("_part", *by).agg(F.min("_at_all").alias("_local"))
    keys = [f"_by{i}" for i in range(len(by))]
    firsts = local.groupBy(*by).agg(F.min("_local").alias("_first")).toDF(*keys, "_first")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    starts = local.join(firsts, same).select(F.col("_part").alias("_in"), *keys, "_first")
    joined = placed.join(starts, [F.col("_part") == F.col("_in"), *same])
    return joined.select(*df.columns, (F.col("_at_all") - F.col("_first")).alias(name))


# Hex digits resolved per pass, and the bucket size that is read out at the end.
RADIX_DIGITS = 4
READ_OUT = 10_000


def hash_cut(df: DataFrame, hashed: Column, ratio: float) -> str:
    """The hash up to which (inclusive) lie exactly ``floor(ratio * n)`` rows.

    Each pass counts rows by the next digits of the hash within the bucket that holds
    the cut: at most 16^4 counts, combined before the shuffle. No row is sorted or
    moved, and the data may be read with the hash column alone. Returns "" for an
    empty first part.
    """
    hashes = df.select(hashed.alias("h"))
    prefix, wanted = "", None
    while True:
        digits = len(prefix) + RADIX_DIGITS
        inside = hashes.filter(F.startswith("h", F.lit(prefix))) if prefix else hashes
        counts = sorted(inside.groupBy(F.substring("h", 1, digits).alias("p")).count().collect())
        if wanted is None:
            total = sum(n for _, n in counts)
            wanted = int(total * ratio)
            if wanted == 0:
                return ""
        for bucket, n in counts:
            if wanted <= n:
                break
            wanted -= n
        if wanted == n:
            # The cut falls on the end of the bucket: everything that starts so is in.
            return bucket + "g"
        if n <= READ_OUT:
            rows = hashes.filter(F.startswith("h", F.lit(bucket))).collect()
            values = sorted(r.h for r in rows)
            if values[wanted - 1] == values[wanted]:
                raise ValueError("the split key is not unique")
            return values[wanted - 1]
        if digits >= 32:
            raise ValueError("the split key is not unique")
        prefix = bucket
