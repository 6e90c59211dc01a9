from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.functions import tutoring
from pairloom.operators import tutor
from pairloom.sources import schemas
from pairloom.streaming import profiles

TEXTS = ["Score: 10 points", "Score: below 5 points", "Score: 7 points", "score: 10 points",
         "Score: 10 points, not Score: below 5 points"]


def _events(n, seed=3):
    """One student holds a third of all events."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.34 else rng.randint(1, 30), i, rng.choice("xyz"), rng.choice(TEXTS)) for i in range(n)]


def _plain(rows):
    out = {}
    for student, _, topic, text in sorted(rows, key=lambda r: r[1]):
        p = out.setdefault(student, {"topic": None, "m": [], "w": []})
        p["topic"] = topic
        if "Score: 10 points" in text:
            p["m"].append(topic)
        elif "Score: below 5 points" in text:
            p["w"].append(topic)
    return out


def test_levels(spark):
    df = spark.createDataFrame([("beginner",), ("intermediate",), ("advanced",), ("odd",), (None,)], "l string")
    assert [r[0] for r in df.select(tutoring.level_to_difficulty("l")).collect()] == ["easy", "medium", "hard", "medium", "easy"]


def test_outcomes(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + [None]], "t string")
    assert [r[0] for r in df.select(tutoring.assessment_outcome("t")).collect()] == ["mastered", "weak", None, None, "mastered", None]


@pytest.mark.parametrize("block", [10_000, 40, 1])
def test_profiles_with_a_hot_student(spark, block):
    rows = _events(900)
    df = spark.createDataFrame(rows, schemas.ASSESSMENT).repartition(6)
    got = {}
    for r in tutor.student_profiles(df, block).orderBy("student_id", "part").collect():
        assert len(r.mastered_topics) + len(r.weak_topics) <= block
        p = got.setdefault(r.student_id, {"topic": r.current_topic, "m": [], "w": [], "parts": []})
        p["m"] += r.mastered_topics
        p["w"] += r.weak_topics
        p["parts"].append(r.part)
    for student, expected in _plain(rows).items():
        p = got.pop(student)
        assert (p["topic"], p["m"], p["w"]) == (expected["topic"], expected["m"], expected["w"])
        assert p["parts"] == list(range(len(p["parts"])))
    assert not got


def test_requests(spark):
    base = dict.fromkeys([f.split()[0] for f in schemas.REQUEST.split(", ")])
    rows = [
        {**base, "request_id": 0, "command": "plan", "subject": "Maths", "target": "pass", "time_available": "1 week"},
        {**base, "request_id": 1, "command": "explain", "concept": "limits", "confusion_point": "epsilon", "current_level": "advanced"},
        {**base, "request_id": 2, "command": "explain", "concept": "limits", "confusion_point": ""},
        {**base, "request_id": 3, "command": "material", "topic": "sets", "current_level": "advanced"},
        {**base, "request_id": 4, "command": "dance"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.REQUEST)
    got = {r.request_id: r for r in tutor.request_prompts(df).collect()}
    assert "Level: beginner" in got[0].user and got[0].agent == "LearningPathAgent" and got[0].temperature == 0.6
    assert "unsure about: epsilon" in got[1].user and "unsure" not in got[2].user
    assert "difficulty hard" in got[3].user
    assert got[4].user is None and got[4].agent is None
    err = df.select(tutoring.error_answer(F.lit("ContentGenerator"), F.lit("no key"))).first()[0]
    assert err == "Error in ContentGenerator: no key"


def _arrive(spark, path, rows, name):
    spark.createDataFrame(rows, schemas.ASSESSMENT).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    rows = _events(600)
    src, log, state, c1, c2 = (str(tmp_path / n) for n in ("in", "log", "state", "c1", "c2"))
    for part in (rows[:250], rows[250:]):
        _arrive(spark, src, part, "x")
        events = spark.readStream.schema(schemas.ASSESSMENT).parquet(src)
        for _ in range(2):  # the second run finds nothing new
            profiles.stream_assessments(events, log, c1).awaitTermination()
            profiles.stream_profiles(events, state, c2).awaitTermination()
    logged = spark.read.parquet(log)
    assert logged.count() == 600
    expected = _plain(rows)
    got = {r.student_id: r for r in tutor.student_profiles(logged).collect()}
    assert {k: (v["topic"], v["m"], v["w"]) for k, v in expected.items()} == {
        k: (r.current_topic, r.mastered_topics, r.weak_topics) for k, r in got.items()
    }
    progress = {tuple(r) for r in profiles.read_progress(spark, state).collect()}
    assert progress == {(k, v["topic"], len(v["m"]), len(v["w"])) for k, v in expected.items()}
