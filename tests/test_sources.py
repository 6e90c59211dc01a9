from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairloom import session
from pairloom.sources import files, resume, schemas

ROWS = [
    {"sft_index": i, "instruction": f"Ünï \"{i}\"\n  }},\n  {{\n", "input": "", "output": "a\tb", "topic": None if i == 2 else "T"}
    for i in range(5)
]


@pytest.mark.parametrize("indent, split", [(2, None), (2, 2), (4, 4), (None, None)])
@pytest.mark.parametrize("n", [0, 1, 5])
def test_json_array(spark, tmp_path, indent, split, n):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(ROWS[:n], ensure_ascii=False, indent=indent), encoding="utf-8")
    got = files.read_json_array(spark, str(path), schemas.SFT, indent=split).orderBy("sft_index").collect()
    assert [(r.sft_index, r.instruction, r.output, r.topic) for r in got] == [
        (r["sft_index"], r["instruction"], r["output"], r["topic"]) for r in ROWS[:n]
    ]


def test_nested_values_do_not_end_an_element(spark, tmp_path):
    rows = [{"prompt": f"p{i}", "criteria_used": ["a", "b"], "extra": [{"x": 1}, {"y": 2}]} for i in range(3)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, indent=2))
    got = files.read_json_array(spark, str(path), "prompt string, criteria_used array<string>, extra array<map<string,int>>", 2)
    assert sorted((r.prompt, r.criteria_used, len(r.extra)) for r in got.collect()) == [(f"p{i}", ["a", "b"], 2) for i in range(3)]


def test_array_scan_splits(spark, tmp_path):
    rows = [{"sft_index": i, "output": "x" * 1000} for i in range(2000)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = files.read_json_array(spark, str(path), schemas.SFT, indent=2)
        assert df.rdd.getNumPartitions() > 4
        assert df.agg(F.countDistinct("sft_index"), F.count("*"), F.sum("sft_index")).first()[:] == (2000, 2000, 1999000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_array_fails(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('[\n  {\n    "sft_index": 1\n  },\n  {\n    "sft_index": \n  }\n]')
    for indent in (None, 2):
        with pytest.raises(Exception):
            files.read_json_array(spark, str(path), schemas.SFT, indent=indent).collect()


def test_jsonl_sets_broken_lines_aside(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"sft_index": 1, "output": "a"}\n\n  \n{"sft_index": 2, "out\n{"sft_index": 3}\n')
    good, bad = files.read_jsonl(spark, str(path), schemas.SFT)
    assert sorted((r.sft_index, r.output) for r in good.collect()) == [(1, "a"), (3, None)]
    assert [r.value for r in bad.collect()] == ['{"sft_index": 2, "out']
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), schemas.SFT, bad="fail").collect()


def test_missing_input_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_jsonl(spark, str(tmp_path / "none"), schemas.SFT)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_write_modes(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    read = lambda: sorted(r[0] for r in spark.read.schema("id long").format(fmt).load(path).collect())
    files.write_dataset(spark.range(3), path, fmt)
    files.write_dataset(spark.range(3, 5), path, fmt, mode="continue")
    assert read() == [0, 1, 2, 3, 4]
    files.write_dataset(spark.range(1), path, fmt)
    assert read() == [0]
    with pytest.raises(KeyError):
        files.write_dataset(spark.range(1), path, fmt, mode="ignore")


def test_append_keeps_text_unescaped(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "Ünï")], "sft_index long, output string")
    files.append_jsonl(df, path)
    files.append_jsonl(df.withColumn("sft_index", F.lit(2)), path)
    assert {r.value for r in spark.read.text(path).collect()} == {
        '{"sft_index":1,"output":"Ünï"}', '{"sft_index":2,"output":"Ünï"}'
    }


def test_peek(spark):
    assert files.peek(spark.range(10)).count() == 3


def test_remaining_ids(spark):
    have = spark.createDataFrame([(0,), (1,), (7,)], "sft_index long")
    assert [r[0] for r in resume.remaining_ids(have, 5).collect()] == [8, 9]
    assert resume.remaining_ids(have, 2).count() == 0
    assert [r[0] for r in resume.remaining_ids(have.limit(0), 2).collect()] == [0, 1]


def test_pending(spark):
    src = spark.range(10).toDF("sft_index")
    have = spark.createDataFrame([(0,), (1,), (4,)], "sft_index long")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(resume.pending_by_hwm(src, have)) == [5, 6, 7, 8, 9]
    assert ids(resume.pending_by_hwm(src, have, 7)) == [5, 6]
    assert ids(resume.pending_by_hwm(src, have.limit(0), 2)) == [0, 1]
    assert ids(resume.pending_by_key(src, have)) == [2, 3, 5, 6, 7, 8, 9]


def test_continued_run_equals_one_run(spark, tmp_path):
    from pairloom.operators import preferences

    rows = [(i, f"Q{i}", "", f"One {i}. Two. Three. Four.", "T", "easy") for i in range(30)]
    sft = spark.createDataFrame(rows, "sft_index long, instruction string, input string, output string, topic string, difficulty string")
    made = preferences.build_preferences(sft)
    path = str(tmp_path / "pref")
    files.write_dataset(made.filter("sft_index < 12 AND sft_index <> 5"), path)
    done = spark.read.parquet(path)
    rest = resume.pending_by_key(made, done)
    in_order = lambda df: df.orderBy("sft_index").collect()
    assert in_order(resume.extend(done, rest)) == in_order(made)


def test_mark_reaches_the_scan(spark, sf):
    src = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "sft_index")
    have = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "sft_index")
    plan = resume.pending_by_hwm(src, have)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,ScalarSubquery" in plan


def test_errors_are_split(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, error string")
    ok, failed = resume.split_errors(df)
    assert [tuple(r) for r in ok.collect()] == [(1,)] and [tuple(r) for r in failed.collect()] == [(2, "x")]


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "/shared"}.get(key, default)

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return "set"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.shared_dir(Session()) == "/shared"
    assert session.fresh_dir(Session(), "x").startswith("/shared/x-")

    class Empty:
        def get(self, key, default=None):
            return default

    Session.conf, Context.getConf = Empty(), lambda self: Empty()
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_each_line_is_parsed_once(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"sft_index": 1}\n{bad\n')
    for df in files.read_jsonl(spark, str(path), schemas.SFT):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
