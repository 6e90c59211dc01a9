"""Tutor requests and student profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import fixed, wording
from pairloom.functions.text import or_empty, render
from pairloom.functions.tutoring import assessment_outcome, level_to_difficulty

# Entries per profile part: the bound on what one group collects.
BLOCK = 100_000
# Consecutive event ids that are ordered in one task.
STRETCH = 1 << 20


def request_prompts(
    requests: DataFrame,
    system: Mapping[str, str] = wording.TUTOR_SYSTEM,
    user: Mapping[str, str] = wording.TUTOR_USER,
    confusion: str = wording.TUTOR_CONFUSION,
) -> DataFrame:
    """Add agent, temperature and both prompts by command; null for an unknown one."""
    level = F.coalesce("current_level", F.lit("beginner"))
    doubt = F.when(
        or_empty("confusion_point") != "", render(confusion, confusion_point="confusion_point")
    ).otherwise("")
    slots = {
        "difficulty": level_to_difficulty("current_level"),
        "current_level": level,
        "confusion": doubt,
        **{
            c: c
            for c in ("subject", "target", "time_available", "topic", "question",
                      "student_answer", "reference_answer", "concept")
        },
    }

    def by_command(texts: Mapping[str, Column], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for command, value in texts.items():
            out = F.when(F.col("command") == command, value).otherwise(out)
        return out

    return requests.withColumns(
        {
            "agent": by_command({c: F.lit(a) for c, (a, _) in fixed.AGENTS.items()}, "string"),
            "temperature": by_command({c: F.lit(t) for c, (_, t) in fixed.AGENTS.items()}, "double"),
            "system": by_command({c: F.lit(t) for c, t in system.items()}, "string"),
            "user": by_command({c: render(t, **slots) for c, t in user.items()}, "string"),
        }
    )


def _numbered(entries: DataFrame, stretch: int) -> DataFrame:
    """Add each entry's number in its student's history.

    A history is cut into stretches of ``stretch`` consecutive event ids, whose rows are
    ordered in one task; the entries of earlier stretches are counted.
    """
    entries = entries.withColumn("_stretch", F.floor(F.col("event_id") / stretch))
    place = F.row_number().over(Window.partitionBy("student_id", "_stretch").orderBy("event_id")) - 1
    counts = entries.groupBy("student_id", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("student_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = entries.withColumn("_place", place).join(before, ["student_id", "_stretch"])
    return joined.withColumn("_at", F.col("_before") + F.col("_place"))


def student_profiles(events: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Mastered and weak topics per student in order of arrival, duplicates kept.

    ``events``: ``student_id, event_id, topic, assessment``, with ``event_id`` unique and
    rising on arrival. Every student's graded entries are numbered, and ``part`` k holds
    the entries from ``k * block`` on; a student without any has an empty part 0. The
    numbers come from stretches of the event ids, so no task and no row ever holds a whole
    long history, and every student goes the same way.
    """
    graded = events.select("student_id", "event_id", "topic", assessment_outcome("assessment").alias("outcome"))
    parts = _numbered(graded.filter(F.col("outcome").isNotNull()), stretch).withColumn("part", F.floor(F.col("_at") / block))
    lists = parts.groupBy("student_id", "part").agg(*_topic_lists())
    current = graded.groupBy("student_id").agg(F.max_by("topic", "event_id").alias("current_topic"))
    none = F.array().cast("array<string>")
    return current.join(lists, "student_id", "left").select(
        "student_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "current_topic",
        *[F.coalesce(c, none).alias(c) for c in LISTS],
    )


LISTS = ["mastered_topics", "weak_topics"]


def _topic_lists() -> list[Column]:
    entry = F.struct("event_id", "topic")

    def topics(outcome: str) -> Column:
        entries = F.collect_list(F.when(F.col("outcome") == outcome, entry))
        return F.transform(F.array_sort(entries), lambda e: e["topic"])

    return [topics("mastered").alias(LISTS[0]), topics("weak").alias(LISTS[1])]


def student_progress(events: DataFrame) -> DataFrame:
    """The short form of a profile, one row per student: the current topic and how many
    entries the two lists have. It needs no list, so it also runs as a stream's state."""
    outcome = assessment_outcome("assessment")
    return events.groupBy("student_id").agg(
        F.max_by("topic", "event_id").alias("current_topic"),
        F.count_if(outcome == "mastered").alias("n_mastered"),
        F.count_if(outcome == "weak").alias("n_weak"),
    )
