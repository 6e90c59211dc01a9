"""Work that grows with the text is done once per text, not once per search or per word."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions.text import plain_spaces, words
from pairloom.operators import frequent


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spaces_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("A\u2003b\tC\nd",), (None,), ("",)], "x string")
    lowered = df.select(plain_spaces(F.lower("x")).alias("p"), words(F.lower("x")).alias("w"))
    assert _plan(lowered).count("lower(") == 2
    assert [tuple(r) for r in lowered.collect()] == [("a b c d", ["a", "b", "c", "d"]), (None, None), ("", [])]


def test_summaries_take_whole_lists():
    lists = [pa.array([["a", "b", None, "a"], None, []], pa.list_(pa.string())), pa.array([["a", "c", "b"], ["d"]], pa.list_(pa.string()))]
    batches = [pa.RecordBatch.from_arrays([x], names=["values"]) for x in lists]
    (whole,) = frequent._summaries(iter(batches), 10)
    assert dict(zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True)) == {"a": 3, "b": 2, "c": 1, "d": 1}
    (few,) = frequent._summaries(iter(batches), 2)
    loss = few.column(2).to_pylist()[0]
    found = dict(zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True))
    assert len(found) <= 2 and all(n - loss <= found.get(v, 0) <= n for v, n in {"a": 3, "b": 2, "c": 1, "d": 1}.items())
    (known,) = frequent._known(iter(batches), pa.array(["b", "x", "d"]))
    assert known.to_pydict() == {"value": ["b", "x", "d"], "n": [2, 0, 1]}
