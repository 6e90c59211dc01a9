"""Joins with a table of unique keys, some of which may be very common among the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a small key and value each, some 32 bytes, sent to every executor.
BROADCAST_ROWS = 1_000_000


def look_up(df: DataFrame, table: DataFrame, key: str, weight: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add the columns of ``table`` (null where it lacks the key), whose keys are unique.

    ``weight`` says how many rows of ``df`` have the key. Up to ``limit`` rows the table is
    broadcast and ``df`` does not move. Beyond, the keys that hold more than one average
    partition's rows, which are at most as many as partitions, are broadcast, and only
    rows without such a key are shuffled.
    """
    spark = df.sparkSession
    n, rows = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    values = table.drop(weight)
    if not n:
        return df.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in values.columns if c != key})
    if n <= limit:
        return df.join(F.broadcast(values), key, "left")
    some = rows // int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    common = table.filter(F.col(weight) > some).drop(weight)
    hot = df.join(F.broadcast(common), key)
    rest = df.join(F.broadcast(common.select(key)), key, "left_anti").join(values, key, "left")
    return hot.unionByName(rest.select(*hot.columns))
