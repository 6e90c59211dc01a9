"""Lists as a stream's state, and pairs from two streams."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import pairing, tutor
from pairloom.plans import fixtures as fx
from pairloom.streaming import lists, scores

START = datetime.datetime(2024, 1, 1)
EVENTS = "student_id long, event_id long, ts timestamp, topic string, assessment string"
GRADES = ["Score: 10 points", "Score: below 5 points", "Score: 7 points", None]


def _deliver(spark, events, src, schema):
    spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def _state(spark, progress):
    return spark.read.format("statestore").load(progress).select("key.*", "value.*")


def test_lists_over_restarts_with_late_events(spark, tmp_path):
    r = random.Random(4)
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events = [(r.choice([1, 1, 1, 2, 3, r.randrange(4, 30)]), i, START + datetime.timedelta(minutes=i), f"t{r.randrange(9)}", r.choice(GRADES)) for i in range(1200)]
    events.append((99, 1200, START + datetime.timedelta(minutes=1200), "only", None))  # never graded
    late = [e for e in events if e[1] % 400 > 360 and e[1] % 3 == 0]
    first = [e for e in events if e not in late]
    runs = [[e for e in first if e[1] // 400 == k] + [e for e in late if e[1] // 400 == k - 1] for k in range(4)]
    most = 0
    for k, run in enumerate([*runs, [(None, -1, START + datetime.timedelta(days=90), "", "")]]):
        r.shuffle(run)
        lists.stream_lists(_deliver(spark, run, src, EVENTS), out, progress, "1 hour", block=7).awaitTermination()
        held = sum(len(s.groupState.ids) if "groupState" in s else len(s.ids) for s in _state(spark, progress).collect())
        most = max(most, held)
        if k == 2:  # nothing is in both the state and the lists, and the state is what the delay spans
            assert 0 < held <= 61 + 40
    assert most <= 61 + 40 and held == 0
    got = {tuple(r) for r in _flat(lists.read_lists(spark, out)).collect()}
    want = _flat(tutor.student_profiles(spark.createDataFrame(events, EVENTS).drop("ts"), block=7))
    assert got == {tuple(r) for r in want.collect()}
    # An event beyond the watermark is not taken, and an idle student costs a number.
    lists.stream_lists(_deliver(spark, [(1, 5000, START, "late", GRADES[0])], src, EVENTS), out, progress, "1 hour", block=7).awaitTermination()
    assert {tuple(r) for r in _flat(lists.read_lists(spark, out)).collect()} == got


def _flat(profile):
    return profile.select("student_id", "part", "current_topic", *[F.array_join(c, ",").alias(c) for c in ("mastered_topics", "weak_topics")])


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_numbers_in_stretches(spark, stretch):
    r = random.Random(1)
    events = [(r.choice([1, 1, 2, r.randrange(9)]), i * 3, f"t{i}", r.choice(GRADES)) for i in range(400)]
    df = spark.createDataFrame(events, "student_id long, event_id long, topic string, assessment string")
    got = {tuple(x) for x in _flat(tutor.student_profiles(df, block=5, stretch=stretch)).collect()}
    assert got == {tuple(x) for x in _flat(tutor.student_profiles(df, block=5, stretch=10**9)).collect()}
    for student in {e[0] for e in events}:
        entries = [e for e in events if e[0] == student and e[3] in GRADES[:2]]
        for part in range(0, max(len(entries), 1), 5):
            own = entries[part : part + 5]
            last = [e for e in events if e[0] == student][-1][2]
            lists_ = [",".join(e[2] for e in own if e[3] == g) for g in GRADES[:2]]
            assert (student, part // 5, last, *lists_) in got


def test_two_streams_restart_and_forget(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sft_index"))
    left = fx.as_sft(docs).withColumn("ts", at)
    right = fx.as_preference(docs).filter("topic <> 'Physics' OR topic IS NULL").withColumn("ts", at + F.expr("INTERVAL 10 seconds"))
    lone = {r.sft_index for r in left.select("sft_index").exceptAll(right.select("sft_index")).collect()}
    assert lone

    def run(lo, hi, tick=False):
        sides = []
        for name, df, key in (("sft", left, -1), ("preference", right, -2)):
            part = df.filter(F.col("sft_index").between(lo, hi))
            if tick:
                one = df.limit(1).withColumns({"sft_index": F.lit(key).cast("bigint"), "ts": F.timestamp_seconds(F.lit(1_900_000_000))})
                part = part.unionByName(one)
            part.coalesce(2).write.mode("append").parquet(f"{src}/{name}")
            sides.append(spark.readStream.schema(df.schema).parquet(f"{src}/{name}"))
        query = scores.stream_joined_scores(*sides, out, progress, "1 day", cfg=fx.SCORING)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    top = docs.agg(F.max("doc_id")).first()[0]
    waiting = [run(0, top // 2), run(top // 2 + 1, top), run(-10, -10, tick=True)]
    rows = spark.read.parquet(out)
    assert {r.pair_id for r in rows.filter("NOT matched").collect()} == lone
    assert rows.filter("NOT matched AND (score IS NOT NULL OR sft_ok IS NULL)").count() == 0
    batch = pairing.score_pairs(fx.as_sft(docs), fx.as_preference(docs), fx.SCORING).collect()
    got = {tuple(r) for r in rows.filter("matched").drop("matched").collect()}
    assert got == {tuple(r) for r in batch if r.pair_id not in lone}
    # Once the watermark has passed, only the ticks are left.
    assert waiting[1] > 2 >= waiting[2]
    assert {tuple(r) for r in scores.joined_stream(left, right, cfg=fx.SCORING).filter("matched").drop("matched").collect()} == got
