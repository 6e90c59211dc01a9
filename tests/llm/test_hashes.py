"""Words that have the same sum modulo 2 ** 64 whatever the constants."""

from __future__ import annotations

import numpy as np

from pairloom.llm import scan
from pairloom.llm.decontamination import benchmark_hits
from pairloom.llm.jaccard_join import near_duplicates
from pairloom.llm.substring_dedup import remove_repeated_runs
from tests.llm import brute

ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_long_slices_have_a_digest():
    data = np.frombuffer(f"{ONE} {OTHER} {ONE}".encode(), np.uint8)
    at = np.array([0, 1025, 2050])
    a, b, c = scan.Sums(data).of(at, at + 1024)
    assert a == c != b


def test_such_words_are_different(spark):
    rest = [f"w{i}" for i in range(12)]
    texts = {d: " ".join([*rest[:6], w, *rest[6:]]) for d, w in enumerate([ONE, OTHER, ONE])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_runs(docs).collect()} == {0: 0, 1: 0, 2: 13}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == brute.near_components(texts) == {0: 0, 1: 1, 2: 0}
    items = spark.createDataFrame([(7, texts[0])], "item_id long, text string")
    assert {r.doc_id: len(r.hits) for r in benchmark_hits(docs.select("doc_id", "text"), items).select("row.doc_id", "hits").collect()} == {0: 13, 1: 0, 2: 13}
