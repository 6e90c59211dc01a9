"""Verdicts of a judge: parsing, result rows, summary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import fixed
from pairloom.functions.prompts import eval_prompt
from pairloom.functions.verdicts import is_json, members, model_total, scores, strip_fence

FIRST, SECOND = fixed.MODELS


def parse_judge(df: DataFrame, reply: str = "verdict") -> DataFrame:
    """Add ``valid``, both score maps, both totals and the summary of a judge's reply.

    A broken reply is invalid. In a valid one, a model without an object of numbers, or
    a reply that reports an error, has no total.
    """
    text = df.withColumn("_json", strip_fence(reply))
    parsed = text.withColumns({"valid": F.coalesce(is_json("_json"), F.lit(False)), "_members": members("_json")})
    usable = F.col("valid") & F.try_element_at("_members", F.lit("error")).isNull()
    points = {
        name: F.when(usable, scores(F.try_element_at("_members", F.lit(model))))
        for name, model in (("first_scores", FIRST), ("second_scores", SECOND))
    }
    scored = parsed.withColumns({**points, "summary": F.when(usable, F.try_element_at("_members", F.lit("Summary")))})
    return scored.withColumns(
        {"first_total": model_total("first_scores"), "second_total": model_total("second_scores")}
    ).drop("_json", "_members")


def eval_results(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One result row per evaluation item.

    ``answers``: ``id, sft_response, dpo_response, verdict, error``. An item whose
    answers failed, or that has none, gets the fixed texts and an error.
    """
    rows = parse_judge(items.join(answers, "id", "left"))
    failed = F.col("error").isNotNull() | (F.col("sft_response").isNull() & F.col("dpo_response").isNull())
    text = lambda c: F.when(failed, fixed.FAILED_ANSWER).otherwise(F.col(c))
    points = lambda c: F.when(~failed, F.col(c))
    return rows.select(
        "id",
        eval_prompt("prompt", "input").alias("prompt"),
        text("sft_response").alias("sft_response"),
        text("dpo_response").alias("dpo_response"),
        F.struct(
            points("first_scores").alias(FIRST),
            points("second_scores").alias(SECOND),
            points("summary").alias("Summary"),
            F.when(failed, fixed.FAILED_VERDICT)
            .when(~F.col("valid"), "invalid verdict")
            .alias("error"),
        ).alias("judge_result"),
        points("first_total").alias("sft_total"),
        points("second_total").alias("dpo_total"),
    )


def judge_summary(parsed: DataFrame) -> DataFrame:
    """Mean points by model and criterion over the valid verdicts."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(FIRST).alias("model"), F.col("first_scores").alias("points")),
            F.struct(F.lit(SECOND).alias("model"), F.col("second_scores").alias("points")),
        )
    )
    rows = parsed.select(sides.alias("side")).select("side.model", F.explode("side.points").alias("criterion", "points"))
    return rows.groupBy("model", "criterion").agg(F.count("points").alias("n"), F.avg("points").alias("mean_points"))


def judge_outcomes(parsed: DataFrame) -> DataFrame:
    """Wins, ties and losses of the second model against the first."""
    a, b = F.col("first_total"), F.col("second_total")
    return parsed.agg(
        F.count_if(b > a).alias("wins"),
        F.count_if(b == a).alias("ties"),
        F.count_if(b < a).alias("losses"),
        F.count_if(a.isNull() | b.isNull()).alias("not_comparable"),
    )


SLOTS = 4


def poisson(uniform: Column, bits: int = 32) -> Column:
    """Draw of a Poisson distribution of mean 1 from a whole number below ``2 ** bits``."""
    below, steps, k = 0.0, [], 0
    while True:
        below += math.exp(-1) / math.factorial(k)
        if round(below * 2**bits) >= 2**bits:
            break
        steps.append(round(below * 2**bits))
        k += 1
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= uniform))


def judge_intervals(parsed: DataFrame, key: str = "id", resamples: int = 200, level: float = 0.95, seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """``measure, n, estimate, lower, upper`` for the mean difference of the totals (second less
    first model) and for the second model's share of wins, a tie counting half.

    The interval is that of ``resamples`` bootstrap samples. A row's weight in a sample is
    a Poisson draw from a hash of its key, so the samples need no order, are the same in
    every run, and come out of one pass in which each task sends a row per sample. Rows
    without both totals do not count; without any the numbers are null.
    """
    a, b = F.col("first_total"), F.col("second_total")
    rows = parsed.filter(a.isNotNull() & b.isNotNull()).select(
        F.col(key).alias("_key"), (b - a).alias("_gap"), F.when(b > a, 1.0).when(b == a, 0.5).otherwise(0.0).alias("_win")
    )
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_gap").alias("mean_difference"), F.avg("_win").alias("win_rate"))
    each = rows.withColumn("_hash", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // SLOTS))))
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string"), F.col("_hash").cast("string")))
    drawn = each.withColumn("_hex", text).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    uniform = F.conv(F.substring("_hex", F.col("_slot") * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    sample = F.col("_hash") * SLOTS + F.col("_slot")
    weighted = drawn.select(sample.alias("_sample"), poisson(uniform).alias("_w"), "_gap", "_win").filter((F.col("_sample") < resamples) & (F.col("_w") > 0))
    sums = weighted.groupBy("_sample").agg(
        (F.sum(F.col("_w") * F.col("_gap")) / F.sum("_w")).alias("mean_difference"), (F.sum(F.col("_w") * F.col("_win")) / F.sum("_w")).alias("win_rate")
    )
    ends = [(1 - level) / 2, (1 + level) / 2]
    bounds = sums.agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{i}") for c in ("mean_difference", "win_rate") for i, p in enumerate(ends)])
    measure = lambda c: F.struct(F.lit(c).alias("measure"), F.col("n"), F.col(c).alias("estimate"), F.col(f"{c}_0").alias("lower"), F.col(f"{c}_1").alias("upper"))
    # One row each: the whole table's and the samples'.
    both = whole.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.inline(F.array(measure("mean_difference"), measure("win_rate"))))
