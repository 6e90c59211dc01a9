"""Continue modes: what is still to be done, given what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def remaining_ids(existing: DataFrame, n: int, key: str = "sft_index") -> DataFrame:
    """As many fresh ids as are missing to reach ``n`` rows."""
    count, top = existing.agg(F.count(F.lit(1)), F.coalesce(F.max(key), F.lit(-1))).first()
    start = top + 1
    return existing.sparkSession.range(start, start + max(0, n - count)).toDF(key)


def pending_by_hwm(src: DataFrame, existing: DataFrame, n: int | None = None, key: str = "sft_index") -> DataFrame:
    """Rows above the highest key present, below ``n``.

    The mark is a scalar subquery, so it reaches the scan of ``src`` as a filter.
    """
    mark = existing.select(F.coalesce(F.max(key), F.lit(-1))).scalar()
    rest = src.filter(F.col(key) > mark)
    return rest if n is None else rest.filter(F.col(key) < n)


def pending_by_key(src: DataFrame, existing: DataFrame, key: str = "sft_index") -> DataFrame:
    """Rows whose key is absent, gaps included."""
    return src.join(existing.select(key), key, "left_anti")


def extend(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    failed = F.col(error).isNotNull()
    return df.filter(~failed).drop(error), df.filter(failed)


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """``df``, or an error where it has no row, raised by the job that reads it.

    A branch without rows is added, which counts to one: every task stops at its first row,
    and where ``df`` comes out of a shuffle, both branches read the same one.
    """
    found = df.select(F.lit(1).alias("_x")).limit(1).agg(F.count(F.lit(1)).alias("_n"))
    none = F.raise_error(F.lit(f"no {what} left after formatting")).cast("boolean")
    guard = found.filter(F.when(F.col("_n") == 0, none).otherwise(False))
    return df.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
