from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from pairloom.operators import profiling
from pairloom.sources.resume import require_rows


def test_distribution_orders_ties_by_first_appearance(spark):
    rows = [(0, "b"), (1, "a"), (2, "c"), (3, "a"), (4, None), (5, "b")]
    df = spark.createDataFrame(rows, "i int, topic string").repartition(3)
    got = profiling.by_frequency(profiling.distribution(df, "topic", "Unknown", "i")).collect()
    assert [(r.value, r.n) for r in got] == [("b", 2), ("a", 2), ("c", 1), ("Unknown", 1)]
    assert abs(sum(r.pct for r in got) - 100) < 1e-9


def test_distribution_of_array_elements(spark):
    df = spark.createDataFrame([(["x", "y"],), (["x"],), ([],)], "criteria array<string>")
    got = {r.value: r.n for r in profiling.distribution(df, "criteria").collect()}
    assert got == {"x": 2, "y": 1}


def test_histogram_edges_belong_to_the_upper_bucket(spark):
    values = [0.0, 0.29, 0.3, 0.59, 0.6, 0.9]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [(r.bucket, r.n) for r in profiling.bucket_counts(df, "d", (0.3, 0.6)).collect()]
    assert got == [("< 0.3", 2), ("0.3 - 0.6", 2), (">= 0.6", 2)]


def test_numeric_profile_uses_the_population_deviation(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    r = profiling.numeric_profile(df, {"d": F.col("d")}).first()
    assert (r.n, r.avg, r.min, r.max) == (4, np.mean(values), 1.0, 9.0)
    assert r.std == pytest.approx(np.std(values))


def test_empty_input(spark):
    df = spark.createDataFrame([], "i int, topic string, d double")
    assert profiling.distribution(df, "topic", "Unknown", "i").count() == 0
    assert profiling.numeric_profile(df, {"d": F.col("d")}).first().n == 0
    assert [r.pct for r in profiling.bucket_counts(df, "d", (0.3,)).collect()] == [0.0, 0.0]
    assert profiling.share(df, F.col("d") > 0).first().pct == 0.0
    assert profiling.dataset_profile(df, {"topic": "Unknown"}).count() == 0
    with pytest.raises(SparkRuntimeException, match="no rows left"):
        require_rows(df).collect()


def test_grouping_sets_equal_single_distributions(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, topic string, difficulty string")
    columns = {"topic": "Unknown", "difficulty": "medium"}
    got = {(r.dimension, r.value, r.n, round(r.pct, 9)) for r in profiling.dataset_profile(df, columns).collect()}
    expected = {
        (c, r.value, r.n, round(r.pct, 9))
        for c, default in columns.items()
        for r in profiling.distribution(df, c, default, "i").collect()
    }
    assert got == expected


def test_validation(spark):
    a, b = spark.range(5), spark.range(4)
    got = {r.check: (r.expected, r.actual, r.ok) for r in profiling.validate(a, b, 5).collect()}
    assert got == {"same_count": (5, 4, False), "target_count": (5, 5, True)}
    assert [r.check for r in profiling.validate(a, a, None).collect()] == ["same_count"]
    assert profiling.warn_small(b, 5).first().ok is False


def test_percent_needs_no_second_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for dist in (
        profiling.distribution(docs, "source", "Unknown", "doc_id"),
        profiling.distribution(docs, "source"),
        profiling.dataset_profile(docs, {"source": "Unknown", "lang": "Unknown"}),
    ):
        dist.collect()
        final = dist._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in final
