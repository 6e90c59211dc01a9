"""Draws, topics, keys, plans and streams where they once lost or multiplied rows."""

from __future__ import annotations

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.functions.draws import digest, draw
from pairloom.operators import pairing, preferences, templates, tutor
from pairloom.operators.indexing import require_unique, with_dense_index, with_group_index
from pairloom.operators.responder import respond
from pairloom.plans import fixtures as fx
from pairloom.streaming import profiles


def test_every_outcome_of_a_draw_is_as_likely(spark):
    n, rows = 40_000, 400_000
    drawn = spark.range(rows).select(draw(digest(1, "id"), 0, n).alias("x"))
    counts = np.zeros(n)
    for r in drawn.groupBy("x").count().collect():
        counts[r.x] = r["count"]
    chi = ((counts - rows / n) ** 2 / (rows / n)).sum()
    assert abs(chi - (n - 1)) < 6 * np.sqrt(2 * (n - 1))
    # Not the first outcomes more often than the last.
    assert abs(counts[: n // 2].sum() / rows - 0.5) < 0.005


def test_topics_beyond_sixteen_bits(spark):
    n = 70_000
    topics = spark.range(n).select(
        F.format_string("t%06d", F.col("id")).alias("topic"),
        F.array(F.lit("c"), F.lit("d")).alias("concepts"),
        F.array(F.lit("q")).alias("questions"),
        F.array(F.lit("p")).alias("problem_types"),
    )
    got = templates.template_rows(spark.range(100_000).toDF("sft_index"), seed=1, knowledge=topics)
    assert got.count() == 100_000
    assert got.agg(F.max("topic")).first()[0] > "t069900"
    assert got.select("topic").distinct().count() > 50_000


def test_topic_numbers_with_gaps_lose_no_rows(spark):
    topics = templates.knowledge_table(spark).withColumn("topic_no", F.col("topic_no") * 7 + 1)
    ids = spark.range(1000).toDF("sft_index")
    plain = templates.template_rows(ids, seed=1).orderBy("sft_index").collect()
    assert templates.template_rows(ids, seed=1, knowledge=topics).orderBy("sft_index").collect() == plain
    with pytest.raises(ValueError):
        templates.template_rows(ids, seed=1, knowledge=topics.unionByName(topics))
    with pytest.raises(ValueError):
        templates.template_rows(ids, seed=1, knowledge=topics.limit(0))


def one_document(spark):
    return spark.createDataFrame([(1, "A b. C d. E.", "en", "src0", 12)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("keys", [[1, 1, 2], [1, None, 2], [-1, -1, -1]])
def test_repeated_and_missing_keys_are_errors(spark, keys):
    df = spark.createDataFrame([(k, "A b.", "x", "t", "easy") for k in keys], "sft_index long, instruction string, input string, topic string, difficulty string")
    df = df.withColumn("output", F.lit("Some text. And more."))
    with pytest.raises(ValueError):
        require_unique(df, "sft_index")
    with pytest.raises(ValueError):
        preferences.build_preferences(df)
    with pytest.raises((SparkRuntimeException, Py4JJavaError), match="not unique"):
        pairing.pair(df, df).collect()
    with pytest.raises((SparkRuntimeException, Py4JJavaError), match="not unique"):
        pairing.score_pairs(df, fx.as_preference(one_document(spark))).collect()


def test_preferences_read_the_texts_once(spark, sf):
    made = preferences.build_preferences(fx.sft(spark, sf), cfg=fx.ANSWERS)
    made.collect()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # the texts, and the keys with their first sentences
    assert made.count() == fx.sft(spark, sf).count()


def test_spread_depends_on_the_setting_only(spark, sf):
    before = spark.conf.get(fx.SPREAD)
    try:
        for parts in ("3", "5"):
            spark.conf.set(fx.SPREAD, parts)
            assert fx.documents(spark, sf).rdd.getNumPartitions() == int(parts)
        spark.conf.unset(fx.SPREAD)
        assert "Repartition" not in fx.documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(fx.SPREAD, before)


def test_index_over_ties_and_hot_groups(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    df = df.withColumn("g", F.when(F.col("id") % 11 > 0, F.col("g")))
    rows = with_group_index(df, ["g"], F.desc("id"), name="at").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.at, r.id))
    assert len(rows) == 5000
    for members in groups.values():
        assert sorted(members) == list(enumerate(sorted((i for _, i in members), reverse=True)))
    assert sorted(r.at for r in with_dense_index(df, "g", "id", name="at").collect()) == list(range(5000))


def test_batched_calls_with_settings(spark):
    seen = spark.createDataFrame(
        [(1, "s", "a", 0.5), (2, None, "b", None), (3, "s", None, 0.1), (4, "s", "bad", 0.2)], "id int, s string, u string, t double"
    )

    def open_fn():
        return lambda rs: [ValueError("no") if r["user"] == "bad" else f"{r.get('temperature')} {r['system']}{r['user']} " for r in rs]

    got = {r.id: (r.response, r.error) for r in respond(seen, "s", "u", open_fn, settings={"temperature": "t"}, batch=True).collect()}
    assert got == {1: ("0.5 sa", None), 2: ("None b", None), 3: (None, None), 4: (None, "ValueError: no")}

    def one():
        return lambda system, user, temperature=None: f"{temperature}{user}"

    got = {r.id: r.response for r in respond(seen, "s", "u", one, settings={"temperature": "t"}).collect()}
    assert got == {1: "0.5a", 2: "Noneb", 3: None, 4: "0.2bad"}

    short = {r.error for r in respond(seen, "s", "u", lambda: lambda rs: [], batch=True).filter("u is not null").collect()}
    assert all("answers to" in e for e in short)


def test_degradation_carries_its_temperature(spark, sf):
    def open_fn():
        return lambda system, user, temperature: f"warm {temperature}"

    how = preferences.ByModel(open_fn, settings={"temperature": F.lit(fixed.DEGRADE_TEMPERATURE)})
    made = preferences.build_preferences(fx.sft(spark, sf).limit(10), how)
    assert {r.rejected for r in made.collect()} == {"warm 0.9"}


def test_a_settled_round_is_not_asked_again(spark, sf, tmp_path):
    log = str(tmp_path / "calls")

    def open_fn():
        def ask(system, user):
            with open(log, "a") as f:
                f.write("x")
            return "An answer. It has words."

        return ask

    made = preferences.build_preferences(fx.sft(spark, sf), preferences.ByModel(open_fn))
    first = len(open(log).read())
    made.count()
    n = fx.sft(spark, sf).count()
    assert first == n
    assert len(open(log).read()) <= 2 * n


def test_progress_is_folded_into_snapshots(spark, sf, tmp_path):
    events = fx.assessments(fx.table(spark, sf, "events"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        events.filter(F.col("event_id") % 5 == k).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    profiles.stream_profiles(stream, out, str(tmp_path / "check"), fold_every=2).awaitTermination()
    got = {r.student_id: r for r in profiles.read_progress(spark, out).collect()}
    assert got == {r.student_id: r for r in tutor.student_progress(events).select("student_id", "current_topic", "n_mastered", "n_weak").collect()}
    assert spark.read.parquet(f"{out}/snapshots").select("upto").distinct().count() == 2
