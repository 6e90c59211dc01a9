"""Topic lists per student, kept as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.functions.tutoring import assessment_outcome
from pairloom.operators.tutor import BLOCK, LISTS

DELTA = (
    "student_id bigint, part bigint, at bigint, current_id bigint, current_topic string, "
    "mastered_topics array<string>, weak_topics array<string>"
)
# Entries closed so far, and the open ones in the order of their time.
STATE = "closed bigint, ids array<bigint>, times array<bigint>, topics array<string>, outcomes array<string>"


def _deltas(student: int, closed: int, entries: list[tuple], block: int) -> tuple[list[tuple], int]:
    """Rows for the entries that closed now, cut where a part of the list ends."""
    rows: list[tuple] = []
    for _, id_, topic, outcome in entries:
        # An event without a grade is no entry; it only moves the current topic.
        part = closed // block if outcome is not None else max(closed - 1, 0) // block
        if not rows or rows[-1][1] != part:
            rows.append((student, part, closed, id_, topic, [], []))
        mastered, weak = rows[-1][5], rows[-1][6]
        if outcome is not None:
            (mastered if outcome == "mastered" else weak).append(topic)
            closed += 1
        rows[-1] = (*rows[-1][:3], id_, topic, mastered, weak)
    return rows, closed


def _close(block: int):
    columns = ["student_id", "part", "at", "current_id", "current_topic", *LISTS]

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # a tick: it only moves the watermark
            for _ in batches:
                pass
            return
        closed, ids, times, topics, outcomes = state.get if state.exists else (0, [], [], [], [])
        entries = list(zip(times, ids, topics, outcomes, strict=True))
        for b in batches:
            entries += zip(b["time"].tolist(), b["event_id"].tolist(), b["topic"], b["outcome"], strict=True)
        entries.sort(key=lambda e: e[:2])
        # The watermark is in milliseconds; what lies at or below it is complete.
        mark = state.getCurrentWatermarkMs()
        n = sum(e[0] <= mark * 1000 for e in entries)
        rows, closed = _deltas(int(key[0]), closed, entries[:n], block)
        rest = entries[n:]
        state.update((closed, *(list(x) for x in (zip(*[(e[1], e[0], e[2], e[3]) for e in rest], strict=True) if rest else ([], [], [], [])))))
        if rest:
            # Entries of a student who stays away are closed as the watermark passes them.
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, mark) + 1)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return update


def stream_lists(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", block: int = BLOCK) -> StreamingQuery:
    """Append what is new in the students' topic lists since the last run, then stop.

    ``events``: ``student_id, event_id, ts, topic, assessment``. An event may come up to
    ``delay`` late and still takes its place in the order of ``ts`` (equal ones by
    ``event_id``). The state of a student is the number of entries that are closed and
    the open ones: those above the watermark, so it does not grow with the history. As the
    watermark passes, entries are closed and written as rows of their list's part
    (``block`` entries); a student without further events is closed by timeout. An event that comes
    later than ``delay`` is not taken, as with every watermark.

    A row without ``student_id`` is a tick: it moves the watermark and nothing else. Each
    batch is written once, also over restarts.
    """
    rows = events.select(
        F.col("student_id").cast("bigint").alias("student_id"), "event_id", "ts", F.unix_micros("ts").alias("time"), "topic", assessment_outcome("assessment").alias("outcome")
    )
    deltas = rows.withWatermark("ts", delay).groupBy("student_id").applyInPandasWithState(
        _close(block), DELTA, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return (
        deltas.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Profiles as ``student_profiles`` gives them, from the closed entries: the rows of a
    part, joined in their order. No history is sorted again."""
    deltas = spark.read.schema(DELTA).parquet(path)
    ordered = F.array_sort(F.collect_list(F.struct("at", "current_id", *LISTS)))
    parts = deltas.groupBy("student_id", "part").agg(ordered.alias("_all"))
    current = deltas.groupBy("student_id").agg(F.max_by("current_topic", F.struct("at", "current_id")).alias("current_topic"))

    def joined(name: str) -> Column:
        return F.flatten(F.transform("_all", lambda d: d[name])).alias(name)

    lists = [joined(c) for c in LISTS]
    return parts.join(current, "student_id").select("student_id", "part", "current_topic", *lists)
