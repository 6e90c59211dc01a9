from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import indexing, pairing, ranking
from pairloom.plans import curation, fixtures as fx


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]), rng.choice("aaab") if i % 10 else None) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "pair_id long, score double, topic string").repartition(7)


def _ranked(rows):
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def test_dense_index(scored):
    rows, df = scored
    got = indexing.with_dense_index(df, F.desc("score"), "pair_id", name="n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(rows)))
    assert [r.pair_id for r in got] == [r[0] for r in _ranked(rows)]


def test_rank_is_stable(scored):
    rows, df = scored
    got = {r.pair_id: r["rank"] for r in ranking.rank(df).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(_ranked(rows))}


@pytest.mark.parametrize("n", [0, 1, 700, 5000])
def test_top_n_both_ways(scored, monkeypatch, n):
    rows, df = scored
    expected = {r[0] for r in _ranked(rows)[:n]}
    assert {r.pair_id for r in ranking.top_n(df, n).collect()} == expected
    monkeypatch.setattr(ranking, "TOP_K_LIMIT", -1)
    assert {r.pair_id for r in ranking.top_n(df, n).collect()} == expected


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_top_n_per_group_both_ways(scored, monkeypatch, n):
    rows, df = scored
    expected = set()
    for topic in ("a", "b", None):
        group = _ranked([r for r in rows if r[2] == topic])
        expected |= {(r[0], i + 1) for i, r in enumerate(group[:n])}
    small = {(r.pair_id, r["rank"]) for r in ranking.top_n_per(df, "topic", n).collect()}
    monkeypatch.setattr(ranking, "GROUP_LIMIT", -1)
    large = {(r.pair_id, r["rank"]) for r in ranking.top_n_per(df, "topic", n).collect()}
    assert small == large == expected


def test_first_n(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in (5, 0, 9, 2, 7)], "sft_index long")
    assert sorted(r[0] for r in ranking.first_n(df, 6, dense=True).collect()) == [0, 2, 5]
    assert sorted(r[0] for r in ranking.first_n(df, 3).collect()) == [0, 2, 5]
    for limit in (ranking.TOP_K_LIMIT, -1):
        monkeypatch.setattr(ranking, "TOP_K_LIMIT", limit)
        for n, expected in ((0, []), (4, [0, 2, 5, 7]), (9, [0, 2, 5, 7, 9])):
            assert sorted(r[0] for r in ranking.first_n(df, n, dense=False).collect()) == expected


def test_curate_keeps_both_sides_together(spark, sf, monkeypatch):
    sft, pref = fx.sft(spark, sf), fx.preferences(spark, sf)
    kept = curation.curate_pairs(sft, pref, 50, fx.SCORING)
    left, right = pairing.unzip_pairs(kept)
    assert left.count() == right.count() == 50
    assert {r[0] for r in left.select("sft_index").collect()} == {r[0] for r in right.select("sft_index").collect()}
    assert left.columns == sft.columns and right.columns == pref.columns
    monkeypatch.setattr(ranking, "TOP_K_LIMIT", 10)
    monkeypatch.setattr(curation, "BROADCAST_IDS", 10)
    again = curation.curate_pairs(sft, pref, 50, fx.SCORING)
    assert {r[0] for r in again.select("pair_id").collect()} == {r[0] for r in kept.select("pair_id").collect()}


def test_kept_ids_are_computed_once(spark, sf):
    kept = curation.curate_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), 50, fx.SCORING)
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_more_wanted_than_there_are(spark, sf):
    kept = curation.best_pairs(fx.sft(spark, sf), fx.preferences(spark, sf), 10_000, fx.SCORING)
    assert kept.count() == fx.sft(spark, sf).count()


def test_texts_do_not_cross_the_score_shuffle(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        scored = pairing.score_pairs(fx.as_sft(docs), fx.as_preference(docs), fx.SCORING)
        lines = scored._jdf.queryExecution().executedPlan().toString().splitlines()
        at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(pair_id" in line]
        assert len(at) == 2
        for i in at:
            assert "AS sft_ok" in lines[i + 1] or "AS preference_ok" in lines[i + 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
