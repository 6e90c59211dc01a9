"""Instruction rows from templates and a table of topics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import fixed
from pairloom.functions.draws import digest, draw, pick
from pairloom.functions.prompts import answer_system, answer_user, fallback_answer
from pairloom.functions.text import fill, render
from pairloom.operators.indexing import require_unique, with_dense_index
from pairloom.operators.responder import Ask, respond

KNOWLEDGE_SCHEMA = (
    "topic_no int, topic string, concepts array<string>, questions array<string>, problem_types array<string>"
)

TOPIC, CONCEPT, CONCEPT2, LEVEL, TEMPLATE, PREFIX, QUESTION, PROBLEM_TYPE, WEEKS = range(9)


def knowledge_table(spark: SparkSession, knowledge: Mapping[str, Mapping] = fixed.KNOWLEDGE) -> DataFrame:
    rows = [
        (i, topic, list(k["concepts"]), list(k["questions"]), list(k["problem_types"]))
        for i, (topic, k) in enumerate(knowledge.items())
    ]
    return spark.createDataFrame(rows, KNOWLEDGE_SCHEMA)


def numbered_topics(knowledge: DataFrame) -> tuple[DataFrame, int]:
    """The topics numbered 0, 1, 2, ... by their own ``topic_no``, if there is one, and
    name; and how many there are. A repeated or missing topic is an error."""
    order = [c for c in ("topic_no", "topic") if c in knowledge.columns]
    require_unique(knowledge, "topic")
    topics = with_dense_index(knowledge, *order, name="_no").withColumn("topic_no", F.col("_no")).drop("_no")
    return topics, topics.count()


def template_rows(
    ids: DataFrame,
    seed: int,
    key: str = "sft_index",
    knowledge: DataFrame | None = None,
    templates: Sequence[tuple[str, str]] = fixed.TEMPLATES,
    prefixes: Mapping[str, Sequence[str]] = fixed.PREFIXES,
    literal: bool = False,
) -> DataFrame:
    """One instruction row per id; the same id and seed always give the same row.

    ``literal=True`` keeps two oddities of the templates: an instruction that asks for
    ``{problem}`` is dropped, and ``{problem_type}`` stays unfilled in an instruction.
    Every other id gives exactly one row, whatever numbers the topic table comes with.
    """
    if knowledge is None:  # numbered as it is made
        topics, n_topics = knowledge_table(ids.sparkSession), len(fixed.KNOWLEDGE)
    else:
        topics, n_topics = numbered_topics(knowledge)
    if not n_topics:
        raise ValueError("no topics")

    levels = list(prefixes)
    d = F.col("_digest")
    drawn = ids.select(key, digest(seed, key).alias("_digest"))
    drawn = drawn.select(
        key,
        "_digest",
        draw(d, TOPIC, n_topics).alias("topic_no"),
        pick(levels, draw(d, LEVEL, len(levels))).alias("difficulty"),
        draw(d, TEMPLATE, len(templates)).alias("_template"),
    ).withColumns(
        {
            "_instruction": pick([t[0] for t in templates], F.col("_template")),
            "_input": pick([t[1] for t in templates], F.col("_template")),
        }
    )
    if literal:
        drawn = drawn.filter(~F.contains("_instruction", F.lit("{problem}")))

    rows = drawn.join(topics, "topic_no").withColumn(
        "concept", pick(F.col("concepts"), draw(d, CONCEPT, F.size("concepts")))
    )
    rows = rows.withColumn("_others", F.array_remove("concepts", F.col("concept")))
    rows = rows.withColumns(
        {
            "concept2": F.when(
                F.size("_others") > 0, pick(F.col("_others"), draw(d, CONCEPT2, F.greatest(F.size("_others"), F.lit(1))))
            ).otherwise(""),
            "_question": pick(F.col("questions"), draw(d, QUESTION, F.size("questions"))),
            "_type": pick(F.col("problem_types"), draw(d, PROBLEM_TYPE, F.size("problem_types"))),
            "_weeks": F.concat((draw(d, WEEKS, fixed.MAX_WEEKS) + 1).cast("string"), F.lit(" weeks")),
            "_problem": render(fixed.APPLICATION_PROBLEM, concept="concept"),
            "_described": render(fixed.PROBLEM_DESCRIPTION, concept="concept"),
        }
    )

    prefix = F.lit(None).cast("string")
    for level, options in prefixes.items():
        prefix = F.when(F.col("difficulty") == level, pick(options, draw(d, PREFIX, len(options)))).otherwise(prefix)

    slots = {"concept": "concept"}
    two = F.contains("_instruction", F.lit("{concept1}")) & F.contains("_instruction", F.lit("{concept2}"))
    body = fill("_instruction", **slots)
    body = F.when(two, fill(body, concept1="concept", concept2="concept2")).otherwise(body)
    body = fill(body, question="_question", topic="topic")
    if not literal:
        body = fill(body, problem="_problem", problem_type="_type")
    input_ = fill(
        "_input", problem_type="_type", problem_desc="_described", duration="_weeks", question="_question", problem="_problem"
    )
    return rows.select(
        key,
        F.concat(prefix, F.lit(": "), body).alias("instruction"),
        F.when(F.col("_input") == "", "").otherwise(input_).alias("input"),
        "topic",
        "concept",
        "concept2",
        "difficulty",
        F.concat(F.substring("_instruction", 1, 20), F.lit("...")).alias("template_type"),
    )


def generate_rows(ids: DataFrame, open_fn: Callable[[], Ask], seed: int, key: str = "sft_index", **kwargs) -> DataFrame:
    """Template rows with a model's answer, or the fallback answer and the error."""
    rows = template_rows(ids, seed, key, **kwargs)
    return respond(
        rows,
        answer_system("topic", "concept", "difficulty"),
        answer_user("instruction", "input"),
        open_fn,
        fallback_answer("instruction", "concept", "topic", "difficulty"),
        out="output",
    )
