"""Long vocabularies are searched once for each category, not for each keyword."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.functions import scoring


def test_long_vocabularies_take_one_pass_for_each_category(spark):
    words = tuple(fixed.CATEGORIES.values())
    odd = (("a.c", "x|y", "é", "(", "d e"), ("",), *words)
    pieces = [w for ws in odd for w in ws] + ["abc", "xy", "É", "d  e", "\n", "日本"]
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(pieces, r.integers(0, 5))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for vocabulary in (words, odd):
        found = df.select("t", scoring.category_bits("t", vocabulary).alias("bits"))
        assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
        for row in found.collect():
            hits = [i for i, ws in enumerate(vocabulary) if row.t is not None and any(w in row.t for w in ws)]
            assert row.bits == sum(1 << i for i in hits[: scoring.ENOUGH_CATEGORIES]), row.t
    few = df.select(scoring.category_bits(F.col("t"), words[:1]).alias("bits"))
    assert "ArrowEvalPython" not in few._jdf.queryExecution().executedPlan().toString()
