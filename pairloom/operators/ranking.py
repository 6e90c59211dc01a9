"""Ranks, top-N and top-N per group with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.operators.indexing import with_dense_index, with_group_index

# An ordered limit ends in one task that sees ``n`` narrow rows from every other task, and
# so does the window of a large group. Beyond these the rank comes from a distributed sort.
TOP_K_LIMIT = 10_000
GROUP_LIMIT = 1_000


def ranked_by(score: str, tie: str) -> tuple[Column, Column]:
    return F.desc(score), F.asc(tie)


def rank(df: DataFrame, score: str = "score", tie: str = "pair_id", name: str = "rank") -> DataFrame:
    """Rank 1, 2, ... by descending score; equal scores keep input order (``tie``)."""
    return with_dense_index(df, *ranked_by(score, tie), name=name, hold=True).withColumn(name, F.col(name) + 1)


def top_n(df: DataFrame, n: int, score: str = "score", tie: str = "pair_id", limit: int | None = None) -> DataFrame:
    """Best ``n`` rows. Give it narrow rows and join the texts back afterwards. Above
    ``limit`` (``TOP_K_LIMIT``) the same rows come from a distributed sort."""
    if n <= (TOP_K_LIMIT if limit is None else limit):
        return df.orderBy(*ranked_by(score, tie)).limit(n)
    indexed = with_dense_index(df, *ranked_by(score, tie), name="_rank", hold=True)
    return indexed.filter(F.col("_rank") < n).drop("_rank")


def top_n_per(
    df: DataFrame,
    by: str | Sequence[str],
    n: int,
    score: str = "score",
    tie: str = "pair_id",
    name: str = "rank",
    limit: int | None = None,
) -> DataFrame:
    """Best ``n`` rows of each group, with their rank.

    For a small ``n`` Spark cuts every group to ``n`` rows per task before the shuffle,
    so a group with a third of all rows moves no more than the others. For a large
    ``n`` (above ``limit``, by default ``GROUP_LIMIT``) the rows are sorted by group and score together, and the rank is the distance
    from the group's first row.
    """
    by = [by] if isinstance(by, str) else list(by)
    if n <= (GROUP_LIMIT if limit is None else limit):
        window = Window.partitionBy(*by).orderBy(*ranked_by(score, tie))
        kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
        return kept.withColumn(name, F.col(name).cast("long"))
    indexed = with_group_index(df, by, *ranked_by(score, tie), name=name, hold=True)
    return indexed.withColumn(name, F.col(name) + 1).filter(F.col(name) <= n)


def first_n(df: DataFrame, n: int, key: str = "sft_index", dense: bool = False) -> DataFrame:
    """First ``n`` rows by a unique key.

    With ``dense=True``, for keys 0, 1, 2, ..., this is a plain filter. Otherwise the key of
    the ``n``-th row is looked up from the key column alone; either way the rows are only compared with a
    value, which the scan can use, and never sorted.
    """
    if dense:
        return df.filter(F.col(key) < n)
    if n <= 0:
        return df.limit(0)
    keys = df.select(key)
    if n <= TOP_K_LIMIT:
        last = keys.orderBy(key).limit(n).agg(F.max(key)).scalar()
    else:
        last = with_dense_index(keys, key, name="_at").filter(F.col("_at") < n).agg(F.max(key)).scalar()
    return df.filter(F.col(key) <= last)
