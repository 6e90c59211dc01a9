"""Calls of a user's function or model with results of any type, kept as they are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Call = Callable[[list[dict[str, Any]]], Sequence[Any]]

# A task's files go to their place when the task ends, not when the job does.
COMMIT_BY_TASK = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def _asked(call: Call, requests: list[dict[str, Any]]) -> list[tuple[Any, str | None]]:
    try:
        answers = list(call(requests))
        if len(answers) != len(requests):
            raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
    except Exception as e:  # a failed call marks its rows and never the job
        return [(None, f"{type(e).__name__}: {e}")] * len(requests)
    return [(None, f"{type(a).__name__}: {a}") if isinstance(a, Exception) else (a, None) for a in answers]


def call_typed(
    df: DataFrame, key: str, inputs: Sequence[str], open_fn: Callable[[], Call], result: str, at_a_time: int = 64, in_flight: int = 4
) -> DataFrame:
    """``key, result, error``: what a callable gives for the ``inputs`` of every row.

    ``open_fn`` runs once per task and gives a callable for a list of requests (dicts of the
    inputs), which returns a value of type ``result`` (such as ``array<int>``), or an
    exception, for each. ``at_a_time`` requests go with a call, and ``in_flight`` calls of a
    task wait at once. Only key and inputs travel to Python, as Arrow batches, and come back as
    Arrow arrays of the declared type; a value that does not fit it fails its row. Calls are
    not repeatable: see ``answer_all``.
    """
    kind = f"{key} {df.schema[key].dataType.simpleString()}, result {result}, error string"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    names = list(inputs)

    def typed(answers: list[tuple[Any, str | None]]) -> list[pa.Array]:
        values, errors = [a for a, _ in answers], [e for _, e in answers]
        try:
            return [pa.array(values, schema.field("result").type), pa.array(errors, pa.string())]
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            for i, v in enumerate(values):
                try:
                    pa.array([v], schema.field("result").type)
                except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                    values[i], errors[i] = None, f"{type(e).__name__}: {e}"
            return [pa.array(values, schema.field("result").type), pa.array(errors, pa.string())]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = open_fn()
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                requests = batch.select(names).to_pylist()
                groups = [requests[i : i + at_a_time] for i in range(0, len(requests), at_a_time)]
                answers = [a for group in pool.map(lambda g: _asked(call, g), groups) for a in group]
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(schema.field(key).type), *typed(answers)], schema=schema)

    return df.select(key, *[c for c in names if c != key]).mapInArrow(ask, kind)


def answers_so_far(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What was answered, also by a job that was lost; one row per key."""
    try:
        return spark.read.schema(kind).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def answer_all(
    df: DataFrame, key: str, inputs: Sequence[str], open_fn: Callable[[], Call], result: str, path: str, rows_per_task: int = 1000, retry: bool = False, **calls: int
) -> DataFrame:
    """``call_typed`` for all rows without an answer below ``path``; gives all answers.

    Rows are dealt to tasks of about ``rows_per_task`` by their key, and a task's answers are in
    place when it ends. So after a lost job only what its unfinished tasks had asked is
    asked again; a finished row never is. ``retry`` asks failed rows again. The key is unique.
    """
    spark = df.sparkSession
    kind = f"{key} {df.schema[key].dataType.simpleString()}, result {result}, error string"
    done = answers_so_far(spark, path, kind)
    known = done.filter("error IS NULL") if retry else done
    todo = df.select(key, *[c for c in inputs if c != key]).join(known.select(key), key, "left_anti")
    n = todo.select(key).count()
    if n:
        asked = call_typed(todo.repartition(max(1, -(-n // rows_per_task)), key), key, inputs, open_fn, result, **calls)
        asked.write.mode("append").option(*COMMIT_BY_TASK).parquet(path)
    every = answers_so_far(spark, path, kind)
    if not retry:
        return every
    # A failed answer stays in its file; the good one counts.
    best = F.min_by(F.struct("result", "error"), F.col("error").isNotNull().cast("int")).alias("_best")
    return every.groupBy(key).agg(best).select(key, "_best.*")
