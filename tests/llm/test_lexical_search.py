"""Ranked search against plain Python, and the graph of shared sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm.lexical_search import length_norm, ranked_search, share

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rank int, item_no string, score string"
ITEMS = "item_id long, text string, doc_id string"


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def _plain(docs, items, k=10):
    counted = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in _terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d, s))
        best = sorted(scored)[:k]
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(best)]
    return sorted(out, key=repr)


def _data():
    r = random.Random(11)
    word = lambda: r.choice(["The", "the", "of", "ßä", "Äx", "漢字", "a1", "x-y", "q_r"]) if r.random() < 0.3 else f"w{int(r.paretovariate(0.6)) % 500}"
    say = lambda n: " ".join(word() for _ in range(n))
    docs = [(d, say(r.randrange(1, 120))) for d in range(300)]
    docs += [(300, None), (301, ""), (302, "-- ??"), (303, say(30_000)), (None, docs[5][1])]
    docs += [(400 + i, docs[7][1]) for i in range(40)]  # ties of equal copies
    docs += [(7, docs[7][1])]  # a repeated row
    common = say(12)
    items = [(i, f"{say(r.randrange(1, 15))} {common if i % 2 else ''} {say(3)} of of") for i in range(60)]
    items += [(100, None), (101, ""), (102, "!!"), (103, "nowhere zzz"), (104, docs[303][1]), (3, items[3][1]), (None, "w1 w2")]
    return docs, items


def _run(spark, docs, items, **kwargs):
    d = spark.createDataFrame([(a, b, 1, "i", "s") for a, b in docs], SCHEMA).repartition(4)
    i = spark.createDataFrame([(a, b, "d") for a, b in items], ITEMS)
    return sorted((tuple(r) for r in ranked_search(d, i, **kwargs).collect()), key=repr)


@pytest.mark.parametrize("kwargs", [{}, {"block_bytes": 20_000, "long": 5_000}, {"k": 3}])
def test_same_ranking(spark, kwargs):
    docs, items = _data()
    assert _run(spark, docs, items, **kwargs) == _plain(docs, items, kwargs.get("k", 10))


def test_empty_tables(spark):
    docs, items = _data()
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == [] and _run(spark, [(1, None)], items) == []


def test_shared_sums():
    r = random.Random(2)
    common, other = list(range(12)), list(range(20, 28))
    items = [Counter(common + r.sample(range(30, 200), 4) + (other if i % 3 == 0 else [])) for i in range(20)]
    items += [Counter(), Counter([1, 1, 1]), Counter([205])]
    plan = share(items)
    x = np.array([r.randrange(1, 100) for _ in range(210)])
    acc = [int(c * x[t]) for t, c in zip(plan.leaf_term, plan.leaf_count, strict=True)]
    adds = 0
    for children in plan.sums:
        acc.append(sum(acc[c] for c in children))
        adds += len(children) - 1
    for counts, parts in zip(items, plan.items, strict=True):
        assert sum(acc[p] for p in parts) == sum(n * x[t] for t, n in counts.items())
        adds += max(len(parts) - 1, 0)
    # The common set is added up once, and so is what every third item has besides.
    assert adds < 0.45 * sum(max(len(c) - 1, 0) for c in items)
    assert share([]).items == [] and share(items, pair_limit=0).size < plan.size


def test_norm_beyond_64_bits():
    n = np.array([3, 10**9])
    assert list(length_norm(n, 10**10, 10**14)) == [25 + 75 * int(x) * 10**10 // 10**14 for x in n]
