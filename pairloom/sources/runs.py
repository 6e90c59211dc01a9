"""A dataset that grows by runs, each of which counts once however often it is repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = "run_id"


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Write ``df`` as run ``run``, then mark it as finished.

    The run has a partition of its own, which a repeated run replaces. A run whose driver
    was lost before the mark is not seen by readers, and its rows go when it is repeated.
    """
    rows = df.withColumn(RUN, F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(f"{path}/rows")
    mark = df.sparkSession.createDataFrame([(run, len(df.columns))], f"{RUN} string, n_columns int").coalesce(1)
    mark.withColumn("of", F.col(RUN)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").parquet(f"{path}/finished")


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    try:
        return sorted(r[RUN] for r in spark.read.schema(f"{RUN} string").parquet(f"{path}/finished").collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished runs, with ``run_id``; the others' partitions are not read."""
    done = finished_runs(spark, path)
    if not done:
        return spark.createDataFrame([], f"{schema}, {RUN} string")
    return spark.read.schema(f"{schema}, {RUN} string").parquet(f"{path}/rows").filter(F.col(RUN).isin(done))
