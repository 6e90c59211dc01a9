"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from pairloom.session import fresh_dir

#: A batch for Python has bounded bytes, whatever the size of its rows.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Settings while a table is written: shuffle files go with its end, and batches are small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **SMALL_BATCHES}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for the actions inside, then those from before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """For actions that bring texts to Python without writing a table."""
    return settings(spark, SMALL_BATCHES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once into the folder that all executors share and read it back. A lost
    executor then repeats only what follows, and several readers do the work once. The
    shuffle files of the write are freed with its end, not with the session's."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
