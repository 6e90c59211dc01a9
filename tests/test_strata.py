"""Quotas and grouped splits against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom import fixed
from pairloom.operators import strata, training
from pairloom.plans import fixtures as fx
from pairloom.plans.curation import curate_pairs

TOPICS = "pair_id long, topic string, difficulty string, score double, extra string"


def _rows(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        topic = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", None, ""])
        score = r.choice([None, float("nan"), 0.5, 0.5, r.random(), -r.random(), 1e308, float("inf"), 5e-324, 0.0, -0.0])
        rows.append((i * 7 - 1000, topic, r.choice(["easy", "hard", None]) if topic != "a" else "easy", score, "x"))
    r.shuffle(rows)
    return rows


def _rank(row):
    s = row[3]
    s = -1e300 if s is None or math.isnan(s) else max(min(s, 1e300), -1e300)
    return (-s, row[0])


def _plain_quotas(sizes, n):
    total = sum(sizes.values())
    n = min(n, total)
    out = {s: n * c // total for s, c in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(n * sizes[s] % total), -sizes[s], tuple((v is not None, v) for v in s)))
    for s in order[: n - sum(out.values())]:
        out[s] += 1
    return out


@pytest.mark.parametrize("read_out, ranges", [(10_000, 4096), (0, 4), (5, 64)])
@pytest.mark.parametrize("n", [0, 1, 700, 2999, 10_000])
def test_quota_top_n(spark, monkeypatch, n, read_out, ranges):
    monkeypatch.setattr(strata, "READ_OUT", read_out)
    monkeypatch.setattr(strata, "RANGES", ranges)
    rows = _rows()
    groups = defaultdict(list)
    for row in rows:
        groups[row[1:3]].append(row)
    quotas = _plain_quotas({s: len(g) for s, g in groups.items()}, n)
    want = sorted(row[0] for s, g in groups.items() for row in sorted(g, key=_rank)[: quotas[s]])
    got = strata.quota_top_n(spark.createDataFrame(rows, TOPICS).repartition(4), ["topic", "difficulty"], n)
    assert got.columns == [c.split()[0] for c in TOPICS.split(", ")]
    assert sorted(r.pair_id for r in got.collect()) == want
    assert len(want) == min(n, len(rows))


def test_quotas_move_and_sort_no_row(spark, sf):
    kept = strata.quota_top_n(spark.createDataFrame(_rows(), TOPICS), "topic", 500)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "Sort" not in plan and "BroadcastHashJoin" in plan


def test_selection_keeps_the_mix(spark, sf):
    sft, pref = fx.sft(spark, sf), fx.preferences(spark, sf)
    n = 60
    kept = curate_pairs(sft, pref, n, fx.SCORING, quota=("topic", "difficulty")).select("sft.topic", "sft.difficulty").collect()
    assert len(kept) == n
    sizes = Counter((r.topic, r.difficulty) for r in sft.select("topic", "difficulty").collect())
    total = sum(sizes.values())
    got = Counter((r.topic, r.difficulty) for r in kept)
    assert all(abs(got[s] - n * c / total) < 1 for s, c in sizes.items())


def test_quotas_by_weight():
    sizes = {("a",): 10, ("b",): 100, ("c",): 100, (None,): 3}
    assert strata.apportion(sizes, 0) == dict.fromkeys(sizes, 0)
    assert strata.apportion(sizes, 1000) == sizes
    even = strata.apportion(sizes, 100, dict.fromkeys(sizes, 1.0))
    assert even[("a",)] == 10 and even[(None,)] == 3 and sorted((even[("b",)], even[("c",)])) == [43, 44]
    assert strata.apportion(sizes, 105, {("a",): 1.0}) == {("a",): 10, **{k: v for k, v in strata.apportion({k: v for k, v in sizes.items() if k != ("a",)}, 95).items()}}
    assert strata.apportion({}, 5) == {}


def test_empty_tables(spark):
    none = spark.createDataFrame([], TOPICS)
    assert strata.quota_top_n(none, "topic", 5).count() == 0
    assert training.split_grouped(none, ["extra"], ["topic"]).count() == 0


def _plain_split(rows, ratio):
    """``rows``: id, prompt parts, stratum."""
    def number(parts):
        text = "\x1f".join([str(fixed.SPLIT_SEED), *["-" if p is None else f"={p}" for p in parts]])
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    key = lambda s: tuple((v is not None, v) for v in s)
    members = defaultdict(list)
    for id_, parts, stratum in rows:
        members[number(parts)].append((id_, stratum))
    groups = defaultdict(list)
    for g, m in members.items():
        groups[min((s for _, s in m), key=key)].append((g, len(m)))
    sizes = {s: sum(n for _, n in gs) for s, gs in groups.items()}
    quotas = _plain_quotas(sizes, int(sum(sizes.values()) * ratio))
    train, following, short = set(), {}, 0
    for s, gs in groups.items():
        taken = 0
        for g, n in sorted(gs):
            if taken + n > quotas[s]:
                following[s] = (g, n)
                break
            taken += n
            train.add(g)
        short += quotas[s] - taken
        quotas[s] -= taken
    for s in sorted(following, key=lambda s: (-quotas[s], key(s))):
        g, n = following[s]
        if n <= short:
            train.add(g)
            short -= n
    return {id_: "train" if g in train else "eval" for g, m in members.items() for id_, _ in m}


@pytest.mark.parametrize("ratio", [0.0, 0.37, 0.9, 1.0])
@pytest.mark.parametrize("limit, read_out", [(1_000_000, 10_000), (0, 0)])
def test_split_grouped(spark, monkeypatch, ratio, limit, read_out):
    monkeypatch.setattr(strata, "READ_OUT", read_out)
    monkeypatch.setattr(strata, "RANGES", 16)
    r = random.Random(5)
    rows = []
    for i in range(4000):
        hot = i % 3 == 0  # one prompt with a third of all rows, in every stratum
        prompt = ("hot", None) if hot else (r.choice([None, f"p{int(r.paretovariate(0.5)) % 900}"]), r.choice(["", "i", None]))
        rows.append((i, prompt, (r.choice(["a", "b", None]), r.choice(["easy", "hard"])) if r.random() < 0.3 else ("a", "easy")))
    df = spark.createDataFrame([(i, *p, *s, 0) for i, p, s in rows], "id long, prompt string, input string, topic string, difficulty string, _at int")
    got = training.split_grouped(df.repartition(5), ["prompt", "input"], ["topic", "difficulty"], ratio, limit=limit)
    assert got.columns == [*df.columns, "split"]
    collected = got.collect()
    assert {x.id: x.split for x in collected} == _plain_split(rows, ratio) and len(collected) == len(rows)
    sides = defaultdict(set)
    for x in collected:
        sides[(x.prompt, x.input)].add(x.split)
    assert all(len(s) == 1 for s in sides.values())


def test_split_without_strata_is_within_one_group(spark):
    df = spark.range(10_000).select("id", F.floor(F.col("id") / 3).alias("prompt"))
    n = training.split_grouped(df, ["prompt"]).filter("split = 'train'").count()
    assert 9000 - 3 < n <= 9000
