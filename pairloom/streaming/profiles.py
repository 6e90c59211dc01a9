"""Student profiles kept up to date per assessment event."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.tutor import student_progress

ROW = "student_id bigint, current_topic string, n_mastered bigint, n_weak bigint"


def stream_assessments(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the arrived events to the log that ``student_profiles`` reads.

    The two topic lists of a profile grow without end, and one student may hold a third
    of all events, so the lists live in this table and not in a task's state.
    """
    return (
        events.select("student_id", "event_id", "topic", "assessment")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_profiles(events: DataFrame, path: str, checkpoint: str, fold_every: int = 20) -> StreamingQuery:
    """Keep current topic and list lengths per student as state; write what changed.

    The state is a few numbers per student. Each task first folds its own events, so a
    very active student sends one row per task to its key. A batch writes to its own
    folder and overwrites it when it runs again, so a retry leaves nothing twice. Every
    ``fold_every`` batches the latest rows are folded into a snapshot, so a reader opens a
    snapshot and at most as many batches.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        if batch % fold_every == fold_every - 1:
            latest = _latest(changed.sparkSession, path, batch)
            latest.write.mode("overwrite").parquet(f"{path}/snapshots/upto={batch}")

    return (
        student_progress(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"upto bigint, {ROW}").parquet(f"{path}/snapshots")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest row per student from the newest snapshot and the batches after it.

    ``before`` leaves out a snapshot of that batch, which a retried batch writes anew.
    """
    changes = spark.read.schema(f"batch bigint, {ROW}").parquet(f"{path}/changes")
    snapshots = _snapshots(spark, path)
    if snapshots is not None:
        whole = snapshots if before is None else snapshots.filter(F.col("upto") < before)
        newest = whole.agg(F.max("upto")).first()[0]
        if newest is not None:
            old = whole.filter(F.col("upto") == newest).withColumnRenamed("upto", "batch")
            changes = changes.filter(F.col("batch") > newest).unionByName(old)
    row = F.struct("current_topic", "n_mastered", "n_weak")
    return changes.groupBy("student_id").agg(F.max_by(row, "batch").alias("row")).select("student_id", "row.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per student."""
    return _latest(spark, path)
