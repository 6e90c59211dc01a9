"""The methods behind the operators, each against its definition."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import jaccard_join, scan
from pairloom.llm.components import components
from pairloom.llm.queries import MODEL, QUERIES
from pairloom.llm.run_length_index import RunLengthIndex, later_windows
from pairloom.llm.segmentation import Vocabulary, sample_block
from pairloom.llm.tables import table
from tests.llm import brute


def _symbols(strings):
    return np.frombuffer("".join(strings).encode(), np.uint8).astype(np.int64), np.cumsum([len(s) for s in strings])


@pytest.mark.parametrize("letters", ["ab", "abcd", "a"])
def test_matching_statistics(letters):
    r = random.Random(3)
    for _ in range(40):
        known = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 6))]
        asked = ["".join(r.choice(letters + "z") for _ in range(r.randint(1, 15))) for _ in range(r.randint(1, 4))]
        index = RunLengthIndex(*_symbols(known))
        symbols, ends = _symbols(asked)
        got = index.matching_statistics(symbols, ends - [len(s) for s in asked], ends).tolist()
        expected = []
        for s in asked:
            for i in range(len(s)):
                expected.append(max(n for n in range(len(s) - i + 1) if any(s[i : i + n] in t for t in known)))
        assert got == expected


def test_later_windows():
    r = random.Random(4)
    for _ in range(30):
        strings = ["".join(r.choice("ab") for _ in range(r.randint(4, 14))).encode() for _ in range(r.randint(2, 9))]
        group = np.sort(np.array([r.randint(0, 2) for _ in strings]))
        n = np.array([len(s) - 3 for s in strings])
        expected = []
        for i, s in enumerate(strings):
            for a in range(n[i]):
                expected.append(any(s[a : a + 4] in strings[j] for j in range(i) if group[j] == group[i]))
        assert later_windows(group, strings, n, 4).tolist() == expected


def test_gumbel_top_k_is_sampling_without_replacement():
    v = Vocabulary(MODEL)
    weight = dict(zip((v.pieces[i] for i in v.ids.tolist()), v.weights.tolist(), strict=True))
    text = "the a"
    paths = {}

    def grow(rest, have, total):
        if not rest:
            paths[have] = total
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                grow(rest[n:], (*have, rest[:n]), total + weight[rest[:n]])

    grow("▁the▁a", (), 0.0)
    norm = np.logaddexp.reduce(list(paths.values()))
    prob = {p: math.exp(w - norm) for p, w in paths.items()}
    n = 20_000
    rows = sample_block([text] * n, scan.mix(np.arange(n, dtype=np.uint64)), 2, v).to_pylist()
    pairs = Counter()
    for row in rows:
        a, b = (tuple(v.pieces[i] for i in s["ids"]) for s in row)
        assert a != b and row[0]["gumbel"] >= row[1]["gumbel"]
        assert abs(math.exp(row[0]["log_prob"]) - prob[a]) < 1e-5
        pairs[a, b] += 1
    likely = sorted(prob, key=prob.get)[-3:]
    for a, b in itertools.permutations(likely, 2):
        p = prob[a] * prob[b] / (1 - prob[a])
        assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    # Inclusion scores weigh the sample back to the whole (Horvitz-Thompson).
    assert abs(np.mean([sum(math.exp(s["log_prob"]) / s["inclusion"] for s in row) for row in rows]) - 1) < 0.01


def test_components(spark):
    r = random.Random(8)
    for edges in ([], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)]):
        label = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in label:
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == label


@pytest.mark.parametrize(("few", "block", "chance"), [(2, 4, 1e-6), (16, 4096, 1.0)])
def test_join_with_small_limits_and_deletions(spark, sf, monkeypatch, few, block, chance):
    """Signatures beyond the limit, comparison in blocks, and one-deletion neighbourhoods
    give the same components."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join.choose_deletions, "__defaults__", (chance,))
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    base = docs[min(docs)]
    for i in range(40):  # a family of near copies
        docs[10_000 + i] = base + f" x{i} y{i}"
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute.near_components(docs)


def test_signature_cost():
    assert jaccard_join.choose_deletions({3: 10**9, 8: 1000, 9: 10**7}) == frozenset({9})


def test_base_spans_against_plain_patterns(spark, sf):
    import re

    patterns = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    check = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m)),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    rows = {r.doc_id: r for r in QUERIES["op2_pii"](spark, sf).collect()}
    total = 0
    for r in table(spark, sf, "documents").collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in p.finditer(r.text or "") if check[k](m[0])]
        total += len(spans)
        assert rows[r.doc_id].base_sha256 == brute.sha(",".join(spans))
        assert rows[r.doc_id].spans.split(",")[: len(spans)] == (spans or [""][: len(spans)])
    assert total


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).filter("held_out").join(table(spark, sf, "documents"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_quality_classifier"](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_words_do_not_cross_rows():
    data, offsets = scan.utf8(pa.array(["ab cd", "ef", None, "", "g  h"]))
    starts, ends, firsts = scan.words(data, offsets, scan.PLAIN)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"g", b"h"]
    assert firsts.tolist() == [0, 2, 3, 3, 3, 5]
