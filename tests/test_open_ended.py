"""Frequent values, diverse rows, resampled verdicts, typed calls, repeated runs, arrays of any layout."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.operators import diversity, frequent, hook, judging, training
from pairloom.plans import fixtures as fx
from pairloom.plans.queries import QUERIES, TOKENIZER
from pairloom.sources import runs
from pairloom.sources.files import read_json_array
from pairloom.sources.json_arrays import array_elements


@pytest.mark.parametrize("counters, k", [(1024, 5), (16, 5), (8, 40), (8, 10_000)])
def test_most_frequent(spark, counters, k):
    r = random.Random(2)
    rows = [[f"w{int(r.paretovariate(0.8))}" for _ in range(r.randrange(0, 60))] + ["hot"] * 5 for _ in range(400)]
    rows += [None, [], [None, "x"], ["tie1", "tie2"] * 3]
    counts = Counter(w for row in rows if row for w in row if w is not None)
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    df = spark.createDataFrame([(row,) for row in rows], "v array<string>").repartition(6)
    got = [tuple(x) for x in frequent.most_frequent(df, "v", k, counters).collect()]
    assert got == [(w, n, best[k][1] if k < len(best) else 0) for w, n in best[:k]]
    assert frequent.most_frequent(df.limit(0), "v").count() == 0


def _plain_greedy(rows, n):
    covered, left, out = set(), dict(rows), []
    while left and len(out) < n:
        gain, id_ = max((len(f - covered) + b, -i) for i, (f, b) in left.items())
        covered |= left.pop(-id_)[0]
        out.append((-id_, len(out) + 1, gain))
    return out


def test_diverse_rows(spark):
    r = random.Random(6)
    rows = {i: ({int(r.paretovariate(0.7)) for _ in range(r.randrange(0, 30))}, r.choice([0.0, 0.5, 2.0])) for i in range(500)}
    df = spark.createDataFrame([(i, list(f) or None, b, "x") for i, (f, b) in rows.items()], "id long, f array<long>, s double, rank string")
    pick = lambda **kw: [tuple(x) for x in diversity.diverse_top_n(df, 40, F.col("f"), key="id", score="s", **kw).orderBy("rank").collect()]
    plain = _plain_greedy(rows, 40)
    assert pick(parts=1, chunk=10_000) == plain
    value = lambda chosen: len(set().union(*(rows[i][0] for i, *_ in chosen))) + sum(rows[i][1] for i, *_ in chosen)
    for parts, chunk in ((20, 4096), (4, 8)):
        spread = pick(parts=parts, chunk=chunk)
        assert len(spread) == 40 and spread == pick(parts=parts, chunk=chunk)
        assert math.isclose(sum(g for *_, g in spread), value(spread))
        assert value(spread) >= 0.9 * value(plain)
    assert diversity.diverse_top_n(df.limit(0), 5, F.col("f"), key="id").count() == 0
    words = diversity.word_features(F.lit("A a  b C"))
    assert spark.range(1).select(F.size(words)).first()[0] == 3


def test_intervals(spark):
    r = random.Random(9)
    rows = [(i, float(r.randrange(10)), float(r.randrange(11))) for i in range(200)] + [(900, None, 1.0), (901, 2.0, None)]
    got = judging.judge_intervals(spark.createDataFrame(rows, "id long, first_total double, second_total double"), resamples=50, level=0.9).collect()
    steps, below = [], 0.0
    for k in range(30):
        below += math.exp(-1) / math.factorial(k)
        steps.append(round(below * 2**32))
    samples = []
    for s in range(50):
        w = [sum(t <= int(hashlib.md5(f"{fixed.SPLIT_SEED}:{i}:{s // 4}".encode()).hexdigest()[s % 4 * 8 :][:8], 16) for t in steps if t < 2**32) for i, *_ in rows[:200]]
        gap = sum(x * (b - a) for x, (_, a, b) in zip(w, rows, strict=False)) / sum(w)
        samples.append((gap, sum(x * (1.0 if b > a else 0.5 if b == a else 0.0) for x, (_, a, b) in zip(w, rows, strict=False)) / sum(w)))
    for row, name, column in zip(got, ("mean_difference", "win_rate"), zip(*samples, strict=True), strict=True):
        assert (row.measure, row.n) == (name, 200)
        assert np.allclose([row.lower, row.upper], np.quantile(column, [0.05, 0.95]))
        assert row.lower < row.estimate < row.upper
    none = judging.judge_intervals(spark.createDataFrame(rows[200:], "id long, first_total double, second_total double")).collect()
    assert [tuple(x) for x in none] == [("mean_difference", 0, None, None, None), ("win_rate", 0, None, None, None)]


def _lengths(log, poison="none of them"):
    def open_fn():
        def call(requests):
            for q in requests:
                if q["text"] == poison:
                    os._exit(1)  # the worker is lost
                with open(f"{log}/{q['id']}", "a") as f:
                    f.write("x")
            return [ValueError("empty") if q["text"] is None else "no list" if q["text"] == "bad" else list(range(len(q["text"]))) for q in requests]

        return call

    return open_fn


def test_typed_calls(spark, tmp_path):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "bad"), (5, "x" * 100)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {x.id: (x.result, x.error) for x in hook.call_typed(df, "id", ["id", "text"], _lengths(tmp_path), "array<int>", at_a_time=2).collect()}
    assert (got[1], got[2], got[5]) == (([0, 1, 2], None), ([], None), (list(range(100)), None))
    assert got[3] == (None, "ValueError: empty") and got[4][0] is None and got[4][1].startswith("Arrow")


def test_a_rerun_asks_nothing_finished_again(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "answers")
    log.mkdir()
    df = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "id long, text string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        hook.answer_all(df, "id", ["id", "text"], _lengths(log, poison="t7"), "array<int>", path, rows_per_task=20).count()
    done = {r.id for r in hook.answers_so_far(spark, path, "id long, result array<int>, error string").collect()}
    assert done and 7 not in done
    before = {int(f.name): len(f.read_text()) for f in log.iterdir()}
    every = hook.answer_all(df, "id", ["id", "text"], _lengths(log), "array<int>", path, rows_per_task=20)
    assert sorted(r.id for r in every.collect()) == list(range(400))
    after = {int(f.name): len(f.read_text()) for f in log.iterdir()}
    assert all(after[i] == before[i] == 1 for i in done)
    again = hook.answer_all(df, "id", ["id", "text"], _lengths(log), "array<int>", path, rows_per_task=20)
    assert again.count() == 400 and {int(f.name): len(f.read_text()) for f in log.iterdir()} == after


def test_failed_rows_are_asked_again_on_request(spark, tmp_path):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, None), (2, "ab")], "id long, text string")
    first = {r.id: r.error for r in hook.answer_all(df, "id", ["id", "text"], _lengths(tmp_path), "array<int>", path).collect()}
    assert first == {1: "ValueError: empty", 2: None}
    mended = df.fillna("abc")
    got = {r.id: (r.result, r.error) for r in hook.answer_all(mended, "id", ["id", "text"], _lengths(tmp_path), "array<int>", path, retry=True).collect()}
    assert got == {1: ([0, 1, 2], None), 2: ([0, 1], None)}


def test_ids_of_a_tokenizer(spark, sf):
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = {
        f"{r.conv_id}-{r.turn}": r.text
        for r in training.chat_sft(fx.chat(spark, sf), keep=("conv_id", "turn")).collect()
    }
    rows = QUERIES["token_ids"](spark, sf).collect()
    assert {r.chat_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.chat_id])
        assert r.input_ids == r.labels == ids[: fixed.TOKEN_BUDGET] and r.truncated == (len(ids) > fixed.TOKEN_BUDGET)
        if not r.truncated:
            assert tokenizer.decode(r.input_ids) == tokenizer.decode(ids)
    assert any(r.truncated for r in rows)


def test_runs_count_once(spark, tmp_path):
    path, schema = str(tmp_path / "d"), "id bigint, v string"
    one = spark.range(10).select("id", F.lit("a").alias("v"))
    assert runs.read_runs(spark, path, schema).count() == 0
    one.filter("id < 4").withColumn("run_id", F.lit("r1")).write.partitionBy("run_id").parquet(f"{path}/rows")
    assert runs.read_runs(spark, path, schema).count() == 0  # no reader sees half a run
    runs.write_run(one, path, "r1")
    runs.write_run(one.withColumn("v", F.lit("b")), path, "r2")
    runs.write_run(one.filter("id < 9"), path, "r1")
    got = runs.read_runs(spark, path, schema)
    assert {(r.run_id, r["count"]) for r in got.groupBy("run_id").count().collect()} == {("r1", 9), ("r2", 10)}
    assert runs.finished_runs(spark, path) == ["r1", "r2"]


SCHEMA = "a bigint, b string, c struct<d: array<string>, e: struct<f: string>>"


def _records(n, r):
    odd = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", "}]", "\n", "ä漢", '{"a": "]}"}', "x" * 50, ""]
    say = lambda: "".join(r.choice(odd) for _ in range(r.randrange(8)))
    return [{"a": i, "b": say(), "c": {"d": [say() for _ in range(r.randrange(3))], "e": {"f": say()}}} for i in range(n)]


@pytest.mark.parametrize("layout", ["minified", "ascii", "indented", "irregular"])
def test_arrays_of_any_layout(spark, tmp_path, layout):
    r = random.Random(7)
    records = _records(3000, r)
    if layout == "irregular":
        text = " \n[ " + "".join(("," if i else "") + r.choice(["", " ", "\n\n\t"]) + json.dumps(x, ensure_ascii=False, indent=r.choice([None, 1, 3])) + r.choice(["", "  "]) for i, x in enumerate(records)) + "\n ]\n\n"
    else:
        text = json.dumps(records, ensure_ascii=layout == "ascii", indent=2 if layout == "indented" else None, separators=(",", ":") if layout == "minified" else None)
    path = tmp_path / "a.json"
    path.write_text(text, encoding="utf-8")
    assert json.loads(text) == records
    size = len(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 12))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 8
        got = [x.asDict(True) for x in read_json_array(spark, str(path), SCHEMA).orderBy("a").collect()]
        order = [json.loads(x.value)["a"] for x in array_elements(spark, str(path)).orderBy("at").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == records and order == list(range(3000))


def test_several_and_empty_and_broken_arrays(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "1.json").write_text('[{"a": 1}, {"a": 2}]')
    (good / "2.json").write_text(" [ ] ")
    (good / "3.json").write_text('[{"a":3,"b":"}"}]\n')
    assert sorted(x.a for x in read_json_array(spark, str(good), "a bigint, b string").collect()) == [1, 2, 3]
    for i, broken in enumerate(['[{"a": 1}', '{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1}, 5]', '[{"a": 1}]]', "[1, 2]", '[{"a": "x}]', '[{"a": x1}]']):
        path = tmp_path / f"broken{i}.json"
        path.write_text(broken)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_json_array(spark, str(path), "a bigint, b string").collect()
