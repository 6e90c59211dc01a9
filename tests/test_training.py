from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import indexing, training

SFT = "sft_index long, instruction string, input string, output string"


def test_chat_rows(spark):
    df = spark.createDataFrame([(0, "Ask", "With", "Say"), (1, "Ask", "", "Say"), (2, "Ask", " ", ""), (3, None, None, "x")], SFT)
    got = {r.sft_index: r.text for r in training.chat_sft(df, keep=("sft_index",)).collect()}
    assert got[0] == "<|im_start|>user\nAsk\nWith<|im_end|>\n<|im_start|>assistant\nSay<|im_end|>"
    assert got[1] == "<|im_start|>user\nAsk<|im_end|>\n<|im_start|>assistant\nSay<|im_end|>"
    assert got[2] == "<|im_start|>user\nAsk\n <|im_end|>\n<|im_start|>assistant\n<|im_end|>"
    flags = {r.sft_index: r.incomplete for r in training.flag_incomplete(df).collect()}
    assert flags == {0: False, 1: False, 2: True, 3: True}


def test_dpo_rows(spark):
    rows = [(0, "p", "c", "r", "in"), (1, "", "c", "r", ""), (2, "p", None, "r", ""), (3, "p", " ", "r", "")]
    df = spark.createDataFrame(rows, "i long, prompt string, chosen string, rejected string, input string")
    got = {r.i: r for r in training.chat_dpo(df, keep=("i",)).collect()}
    assert set(got) == {0, 3}
    assert got[0].prompt == "<|im_start|>user\np\nin<|im_end|>\n<|im_start|>assistant\n"
    assert (got[3].chosen, got[3].rejected) == (" ", "r")


@pytest.mark.parametrize("n, ratio", [(1, 0.9), (10, 0.9), (3000, 0.9), (777, 0.33), (50, 0.0), (50, 1.0)])
def test_split_is_exact_and_repeatable(spark, monkeypatch, n, ratio):
    df = spark.range(n)
    a = {r.id: r.split for r in training.split_exact(df, "id", ratio=ratio).collect()}
    assert sum(v == "train" for v in a.values()) == math.floor(n * ratio)
    monkeypatch.setattr(indexing, "READ_OUT", 0)
    monkeypatch.setattr(indexing, "RADIX_DIGITS", 1)
    b = {r.id: r.split for r in training.split_exact(df.repartition(7), "id", ratio=ratio).collect()}
    assert a == b


def test_split_refuses_a_key_that_repeats(spark):
    with pytest.raises(ValueError):
        training.split_exact(spark.range(100).select((F.col("id") * 0).alias("id")), "id")


def test_bucket_split_is_about_right(spark):
    n = training.split_bucket(spark.range(5000), "id").filter("split = 'train'").count()
    assert 4350 < n < 4650


def test_token_budget(spark):
    texts = ["", "  ", " a b ", "a\nb\tc\xa0d", " ".join(map(str, range(128))), " ".join(map(str, range(129))) + " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in training.token_budget(df).collect():
        assert r.tokens == r.text.split()[:128] == r.labels
        assert r.truncated == (len(r.text.split()) > 128)
    share = training.truncation_share(training.token_budget(df)).first()
    assert (share.n, share.n_truncated) == (6, 1)


def _accuracy(rows, shift=0):
    seen = hit = 0
    for pred, label in rows:
        label = label[shift:]
        for a, b in zip(pred, label):
            if b != -100:
                seen += 1
                hit += a == b
    return hit, seen


@pytest.mark.parametrize("shift", [0, 1])
def test_masked_accuracy(spark, shift):
    rows = [([1, 2, 3], [1, -100, 4]), ([5, 6], [5, 6, 7]), ([9, 9, 9], [9]), ([], []), ([-100, 1], [-100, 1])]
    df = spark.createDataFrame(rows, "p array<int>, l array<int>")
    r = training.masked_accuracy(df, "p", "l", shift=shift).first()
    hit, seen = _accuracy(rows, shift)
    assert (r.correct, r.total) == (hit, seen) and r.accuracy == hit / seen


def test_accuracy_without_labels_is_zero(spark):
    df = spark.createDataFrame([([1], [-100])], "p array<int>, l array<int>")
    assert training.masked_accuracy(df, "p", "l").first().accuracy == 0.0


def test_argmax_takes_the_first(spark):
    rows = [[0.1, 0.9, 0.9], [3.0], [-1.0, -2.0]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    assert [r[0] for r in df.select(training.argmax("v")).collect()] == [int(np.argmax(r)) for r in rows]
