from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom import fixed, wording
from pairloom.functions import prompts
from pairloom.operators import preferences as p
from tests import plain

LONG = "The theory is old. The model is a system. Its structure follows a principle. A concept 42 ends it. " * 3


@pytest.fixture(scope="module")
def sft(spark):
    rows = [
        (i, f"Question {i}", "data" if i % 3 == 0 else " ", LONG if i % 2 else f"Only {i}. Then more. And more. Rest {i}.",
         "Physics" if i < 20 else None, None)
        for i in range(24)
    ]
    return spark.createDataFrame(rows, "sft_index long, instruction string, input string, output string, topic string, difficulty string")


def _first(i):
    return fixed.STRATEGIES[i % 6]


def _other(i):
    rest = [s for s in fixed.STRATEGIES if s != _first(i)]
    return rest[(i + 1) % 5]


def test_strategies(spark):
    df = spark.range(30).withColumn("first", p.strategy("id")).withColumn("other", p.other_strategy("id", "first"))
    assert all((r.first, r.other) == (_first(r.id), _other(r.id)) for r in df.collect())


def test_prompt_skips_a_blank_input(sft):
    rows = {r.sft_index: r for r in p.chosen_side(sft).collect()}
    assert rows[0].prompt == "Question 0\ndata"
    assert rows[1].prompt == "Question 1"
    assert (rows[21].topic, rows[21].difficulty) == ("Unknown", "medium")


def test_rules(spark):
    text = "One 1. Two 2.  Three"
    rows = [(s,) for s in fixed.STRATEGIES]
    df = spark.createDataFrame(rows, "how string").withColumn("t", F.lit(text)).withColumn("spare", F.lit("Spare"))
    got = {r.how: r.w for r in df.select("how", p.weaken("t", "how", "spare").alias("w")).collect()}
    assert got["oversimplify"] == "One 1."
    assert got["incomplete"] == "One 1."
    assert got["add_irrelevant"] == text + " Spare."
    assert got["make_vague"] == wording.HEDGE + "One . Two .  Three"
    assert sorted(got["disorganize"].rstrip(".").split(". ")) == ["One 1", "Three", "Two 2"]
    assert got["add_errors"] is None
    blank = df.withColumn("t", F.lit(" . ")).select("how", p.weaken("t", "how", "spare").alias("w"))
    assert {r.how: r.w for r in blank.collect()}["incomplete"] == ""


def test_spare_sentence_is_the_next_rows_and_wraps(spark):
    rows = [(i, "a" if i != 3 else "b", f"First {i}. Second.") for i in (0, 1, 2, 3, 1000, 1001)]
    df = spark.createDataFrame(rows, "sft_index long, topic string, t string")
    got = p.with_spare_sentence(df, "t", F.col("sft_index") != 1, out="spare").collect()
    spare = {r.sft_index: r.spare for r in got}
    assert len(got) == 6
    assert spare == {0: "First 1", 1: None, 2: "First 0", 3: "First 3", 1000: "First 1001", 1001: "First 1000"}


def test_built_rows(sft):
    rows = {r.sft_index: r for r in p.build_preferences(sft).collect()}
    assert len(rows) == 24
    source = {r.sft_index: r for r in sft.collect()}
    for i, r in rows.items():
        assert r.chosen == source[i].output
        assert r.quality_difference == max(plain.answer_score(r.chosen) - plain.answer_score(r.rejected), 0)
        assert 0 <= r.quality_difference <= 0.95
        assert r.degradation_strategy in (_first(i), _other(i))
        assert 2 <= len(r.criteria_used) <= 3 and len(set(r.criteria_used)) == len(r.criteria_used)
        if r.degradation_strategy == "add_errors":
            assert r.rejected == fixed.FALLBACK_RESPONSE.replace("{prompt}", r.prompt)
    assert {r.degradation_strategy == _first(i) for i, r in rows.items()} == {True, False}
    assert p.build_preferences(sft).columns == [*p.PREFERENCE_COLUMNS, "sft_index"]


def test_same_rows_whatever_the_partitions(sft):
    a = p.build_preferences(sft.repartition(1)).orderBy("sft_index").collect()
    b = p.build_preferences(sft.repartition(5, "topic")).orderBy("sft_index").collect()
    assert a == b


def test_first_n(sft):
    assert p.build_preferences(sft, n=5).count() == 5


def test_model_is_asked_again_for_weak_rows_only(spark, sft, tmp_path):
    log = str(tmp_path)

    def open_fn():
        import os
        import uuid

        def ask(system, user):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(user)
            if "Question 7" in user:
                raise RuntimeError("down")
            return LONG if "Question 1\n" in user + "\n" else "Bad."

        return ask

    made = p.build_preferences(sft.repartition(3), p.ByModel(open_fn))
    rows = {r.sft_index: r for r in made.collect()}
    import os

    sent = [open(os.path.join(log, f)).read() for f in os.listdir(log)]
    weak = [i for i in rows if rows[i].degradation_strategy == _other(i)]
    assert rows[1].degradation_strategy == _other(1) and rows[1].quality_difference == 0.0
    assert rows[7].rejected == fixed.FALLBACK_RESPONSE.replace("{prompt}", rows[7].prompt)
    assert len(sent) == len(rows) + len(weak)


def test_retry_keeps_a_worse_second_answer(spark):
    rows = [(0, "q", LONG, LONG, "Physics", _first(0), 0.0), (1, "q", LONG, "x", "Physics", _first(1), 0.8)]
    df = spark.createDataFrame(
        rows, "sft_index long, prompt string, chosen string, rejected string, topic string, degradation_strategy string, quality_difference double"
    )
    got = {r.sft_index: r for r in p.retry_weak(df, p.ByRule()).collect()}
    assert got[0].retried and got[0].degradation_strategy == _other(0)
    assert not got[1].retried and got[1].rejected == "x" and got[1].quality_difference == 0.8


def test_criteria_text(spark):
    df = spark.createDataFrame([(["depth", "clarity"],)], "c array<string>")
    r = df.select(p.criteria_text("c").alias("a"), p.criteria_text("c", None, ", ").alias("b")).first()
    assert (r.a, r.b) == ("more analytically deep and clearer and better organized", "depth, clarity")


def test_unknown_strategy_gets_the_default_request(spark):
    df = spark.createDataFrame([("nope",), ("add_errors",)], "how string")
    got = {
        r.how: (r.s, r.u)
        for r in df.select(
            "how", prompts.degradation_system("how").alias("s"), prompts.degradation_prompt(F.lit("Q"), F.lit("T"), "how").alias("u")
        ).collect()
    }
    assert got["nope"] == ("", wording.DEGRADE_USER["oversimplify"].replace("{prompt}", "Q"))
    assert "T" in got["add_errors"][1] and "add_errors" in got["add_errors"][0]
