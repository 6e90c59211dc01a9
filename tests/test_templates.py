from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.functions import prompts
from pairloom.operators import templates
from pairloom.operators.responder import respond


@pytest.fixture(scope="module")
def rows(spark):
    return templates.template_rows(spark.range(3000).toDF("sft_index"), seed=1).collect()


def test_rows_are_drawn_from_the_tables(rows):
    assert len(rows) == 3000
    for r in rows:
        k = fixed.KNOWLEDGE[r.topic]
        assert r.concept in k["concepts"] and r.concept2 in k["concepts"] and r.concept != r.concept2
        prefix, body = r.instruction.split(": ", 1)
        assert prefix in fixed.PREFIXES[r.difficulty]
        assert "{" not in r.instruction and "{" not in r.input
        assert r.template_type.endswith("...") and len(r.template_type) <= 23


def test_every_choice_occurs_about_as_often(rows):
    for pick, n in ((lambda r: r.topic, 5), (lambda r: r.difficulty, 3), (lambda r: r.template_type, 11)):
        values = [pick(r) for r in rows]
        counts = {v: values.count(v) for v in set(values)}
        # two pairs of templates begin alike, so there may be fewer beginnings than templates
        assert len(counts) <= n
        assert min(counts.values()) > 0.6 * 3000 / n


def test_rerun_and_partitions_do_not_matter(spark, rows):
    again = templates.template_rows(spark.range(3000).toDF("sft_index").repartition(11), seed=1).collect()
    assert set(again) == set(rows)
    other = templates.template_rows(spark.range(3000).toDF("sft_index"), seed=2).collect()
    assert set(other) != set(rows)


def test_literal_templates(spark, rows):
    ids = spark.range(3000).toDF("sft_index")
    literal = {r.sft_index: r for r in templates.template_rows(ids, seed=1, literal=True).collect()}
    lost = [r for r in rows if r.sft_index not in literal]
    assert lost and all("-related problem: " + fixed.APPLICATION_PROBLEM.split("{")[0] in r.instruction for r in lost)
    open_ = [r for r in literal.values() if "{problem_type}" in r.instruction]
    assert open_ and all(r.instruction.endswith("to solve {problem_type} problems?") for r in open_)


def test_own_knowledge_table(spark):
    topics = templates.knowledge_table(
        spark, {"Cooking": {"concepts": ("Salt",), "questions": ("Why?",), "problem_types": ("Taste",)}}
    )
    got = templates.template_rows(spark.range(50).toDF("sft_index"), 3, knowledge=topics).collect()
    assert {(r.topic, r.concept, r.concept2) for r in got} == {("Cooking", "Salt", "")}


@pytest.mark.parametrize(
    "instruction, level, part",
    [
        ("Please EXPLAIN this", "easy", fixed.FALLBACK_EASY),
        ("What is it", "medium", fixed.FALLBACK_MEDIUM),
        ("explain the difference", "hard", fixed.FALLBACK_HARD),
        ("Explain", "odd", fixed.FALLBACK_HARD),
        ("Compare them", "easy", fixed.FALLBACK_COMPARE),
        ("A difference to learn", "easy", fixed.FALLBACK_COMPARE),
        ("An application to study", "easy", fixed.FALLBACK_EXAMPLE),
        ("A study plan", "easy", fixed.FALLBACK_LEARN),
        ("Solve it", "easy", ""),
    ],
)
def test_fallback_answer(spark, instruction, level, part):
    df = spark.createDataFrame([(instruction, "Optics", "Physics", level)], "i string, c string, t string, d string")
    got = df.select(prompts.fallback_answer("i", "c", "t", "d")).first()[0]
    fill = lambda x: x.replace("{concept}", "Optics").replace("{topic}", "Physics").replace("{difficulty}", level)
    explain = fill(fixed.FALLBACK_EXPLAIN) if part in (fixed.FALLBACK_EASY, fixed.FALLBACK_MEDIUM, fixed.FALLBACK_HARD) else ""
    assert got == fill(fixed.FALLBACK_BASE) + explain + fill(part)


def test_generate_falls_back_per_row(spark):
    def open_fn():
        def ask(system, user):
            if "Physics" in system:
                raise TimeoutError("late")
            return "  answer  "

        return ask

    got = templates.generate_rows(spark.range(200).toDF("sft_index"), open_fn, seed=1).collect()
    assert {r.topic == "Physics" for r in got} == {True, False}
    for r in got:
        if r.topic == "Physics":
            assert r.error == "TimeoutError: late" and r.output.startswith(f"This is a {r.difficulty} level")
        else:
            assert (r.output, r.error) == ("answer", None)


def test_model_is_opened_once_per_task_and_null_is_not_sent(spark):
    def open_fn():
        import uuid

        token = uuid.uuid4().hex
        return lambda system, user: token

    df = spark.range(100).repartition(3).withColumn("user", F.when(F.col("id") % 2 == 0, "hi"))
    got = respond(df, F.lit(""), "user", open_fn).collect()
    assert len({r.response for r in got if r.response}) == 3
    assert all((r.response is None) == (r.user is None) for r in got)
