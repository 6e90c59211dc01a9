from __future__ import annotations

import json

from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.functions.verdicts import strip_fence
from pairloom.operators import judging

GOOD = json.dumps(
    {"SFT_Model": {"Accuracy": 3, "Difficulty_Match": 4.5, "Educational_Value": 2}, "DPO_Model": {"Accuracy": 5}, "Summary": "ok"}
)


def _parse(spark, *replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, verdict string")
    return judging.parse_judge(df).orderBy("id").collect()


def test_fences(spark):
    replies = [f"```json\n{GOOD}\n```", f"```json{GOOD}```  ", GOOD, f" ```json\n{GOOD}\n```"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [r[0] for r in df.select(strip_fence("r")).collect()]
    assert got[:3] == [GOOD] * 3
    assert got[3] == replies[3]


def test_totals(spark):
    no_first = json.dumps({"DPO_Model": {"Accuracy": 1}, "Summary": ""})
    text_first = json.dumps({"SFT_Model": "great", "DPO_Model": {"Accuracy": 1}})
    failed = json.dumps({"error": "x", "SFT_Model": {"Accuracy": 1}})
    got = _parse(spark, GOOD, "not json", no_first, text_first, failed, "", None, "[1]", '{"SFT_Model": {}}')
    assert [(r.valid, r.first_total, r.second_total) for r in got] == [
        (True, 9.5, 5.0),
        (False, None, None),
        (True, None, 1.0),
        (True, None, 1.0),
        (True, None, None),
        (False, None, None),
        (False, None, None),
        (True, None, None),
        (True, 0.0, None),
    ]


def test_summary_and_outcomes(spark):
    other = json.dumps({"SFT_Model": {"Accuracy": 5}, "DPO_Model": {"Accuracy": 5}})
    df = spark.createDataFrame([(GOOD,), (other,), ("broken",)], "verdict string")
    parsed = judging.parse_judge(df)
    means = {(r.model, r.criterion): (r.n, r.mean_points) for r in judging.judge_summary(parsed).collect()}
    assert means[("SFT_Model", "Accuracy")] == (2, 4.0)
    assert means[("DPO_Model", "Accuracy")] == (2, 5.0)
    r = judging.judge_outcomes(parsed).first()
    assert (r.wins, r.ties, r.losses, r.not_comparable) == (0, 1, 1, 1)


def test_result_rows(spark):
    items = spark.createDataFrame(
        [("a", "P", ""), ("b", "P", "code\n  x"), ("c", "P", " "), ("d", "P", None)], "id string, prompt string, input string"
    )
    answers = spark.createDataFrame(
        [("a", "s", "d", GOOD, None), ("b", None, None, None, "boom"), ("c", "s", "d", "nonsense", None)],
        "id string, sft_response string, dpo_response string, verdict string, error string",
    )
    got = {r.id: r for r in judging.eval_results(items, answers).collect()}
    assert [got[k].prompt for k in "abcd"] == ["P", "P\ncode\n  x", "P\n ", "P"]
    assert (got["a"].sft_response, got["a"].sft_total, got["a"].judge_result.error) == ("s", 9.5, None)
    for k in "bd":
        assert got[k].sft_response == got[k].dpo_response == fixed.FAILED_ANSWER
        assert got[k].judge_result.error == fixed.FAILED_VERDICT
    assert (got["c"].sft_response, got["c"].sft_total, got["c"].judge_result.error) == ("s", None, "invalid verdict")
    assert got["a"].judge_result.SFT_Model["Difficulty_Match"] == 4.5
