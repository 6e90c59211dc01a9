"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import anchors
from pairloom.llm.decontamination import benchmark_hits, is_contaminated, remove_benchmark
from pairloom.llm.exact_dedup import duplicate_groups
from pairloom.llm.jaccard_join import near_duplicates
from pairloom.llm.language_id import identify_languages, train_prototypes
from pairloom.llm.line_dedup import dedup_lines
from pairloom.llm.pii import base_spans, find_personal_data
from pairloom.llm.quality import Settings, score_documents, train
from pairloom.llm.queries import MODEL
from pairloom.llm.run_length_index import remove_repeated_bytes
from pairloom.llm.segmentation import decode, sample_segmentations
from pairloom.llm.substring_dedup import remove_repeated_runs
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, row string, samples int, score int, doc string"


def _words(n, seed, alphabet=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(alphabet)}" for _ in range(n))


def _texts():
    long = _words(30_000, 1, 5000)
    passage = _words(40, 2)
    lines = "\n".join(_words(6, 100 + i) for i in range(8))
    return {
        1: None,
        2: "",
        3: " \n\t ",
        4: "one two",
        5: "One two",
        6: long,
        7: _words(20, 3) + " " + passage + " " + _words(20, 4),
        8: _words(25, 5) + " " + passage + " " + _words(9, 6),
        9: passage,
        10: lines,
        11: "x\n" + lines + "\ny",
        12: "same word " * 200,
        13: "äöü ☃ 漢字 " * 30,
        14: long.replace("w17 ", "W17  ", 3) + " end",
        15: _words(60, 7),
        16: _words(60, 7) + " tail",
        17: "a" * 5000,
        18: "\n\n\n\n\n",
        19: "-- ?? !!",
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "xx" if d % 2 else None, "r", 1, 2, "z") for d, t in _texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without id, repeated rows, and an id with two texts."""
    text = _words(80, 9)
    rows = [(None, text), (None, None), (1, text), (1, text), (2, text), (3, text + " more"), (3, "short")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_bytes(docs, odd, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.runs], bytes(r.kept)) for r in remove_repeated_bytes(docs).collect()}
    assert got == brute.repeated_bytes(_texts())
    assert remove_repeated_bytes(none).count() == 0
    by_id = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_bytes(odd).collect())
    assert len(by_id) == 7
    assert [x for x in by_id if x[0] in (0, 1)] == [(0, 0), (0, 0), (1, 0), (1, 0)]
    assert [x for d, x in by_id if d == 2] == [len(_words(80, 9).encode())]


def test_repeated_bytes_with_heavy_anchors(docs, monkeypatch):
    monkeypatch.setattr(anchors.heavy_anchors, "__defaults__", (500,))
    got = {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.runs], bytes(r.kept)) for r in remove_repeated_bytes(docs).collect()}
    assert got == brute.repeated_bytes(_texts())


def test_repeated_runs(docs, odd, none):
    got = {r.doc_id: (r.n_words, r.n_removed, [tuple(x) for x in r.runs], r.kept_text) for r in remove_repeated_runs(docs).collect()}
    assert got == brute.repeated_words(_texts())
    assert remove_repeated_runs(none).count() == 0
    removed = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_runs(odd).collect())
    assert removed == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 80), (3, 0), (3, 80)]


def test_repeated_runs_with_heavy_anchors(docs, monkeypatch):
    monkeypatch.setattr(anchors.heavy_anchors, "__defaults__", (500,))
    got = {r.doc_id: (r.n_words, r.n_removed, [tuple(x) for x in r.runs], r.kept_text) for r in remove_repeated_runs(docs).collect()}
    assert got == brute.repeated_words(_texts())


def test_lines(docs, odd, none):
    got = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in dedup_lines(docs).collect()}
    assert got == brute.repeated_lines(_texts())
    assert dedup_lines(docs).select("row.*").columns == docs.columns
    assert dedup_lines(none).count() == 0
    assert dedup_lines(odd).agg(F.sum("n_removed")).first()[0] == 0


def test_near_duplicates(docs, odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    expected = brute.near_components(_texts())
    assert got == {d: (len(brute.shingles(t)), expected[d]) for d, t in _texts().items()}
    assert near_duplicates(none).count() == 0
    rows = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(odd).collect())
    assert rows == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 3)]


def test_exact(docs, odd, none):
    rows = duplicate_groups(docs).collect()
    texts = {d: (t or "").translate(brute.UP) for d, t in _texts().items()}
    for r in rows:
        same = [d for d, t in texts.items() if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == brute.sha(texts[r.doc_id])
    assert len(rows) == len(texts)
    assert duplicate_groups(none).count() == 0
    small = {r.doc_id: r.keep_id for r in duplicate_groups(odd, keep="smallest", fan_in=2, rounds=3).collect() if r.doc_id in (1, 2)}
    assert small == {1: 1, 2: 1}
    with pytest.raises(ValueError):
        duplicate_groups(docs, keep="any")


def test_benchmark(spark, docs, none):
    passage = _words(40, 2)
    items = {1: passage, 2: "one TWO", 3: None, 4: "", 5: _words(12, 50), 6: _words(13, 51)}
    bench = spark.createDataFrame([*items.items(), (1, passage), (None, "漢字")], "item_id long, text string")
    for size in (1 << 20, 200):  # one block, and many
        got = {r.row.doc_id: (r.n_words, len(r.hits), sorted(r["items"])) for r in benchmark_hits(docs, bench, block_bytes=size).collect()}
        for d, t in _texts().items():
            n, hit, found = brute.contamination(t, {**items, 99: "漢字"})
            assert got[d] == (n, hit, [x for x in found if x != 99])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(docs, empty).filter(is_contaminated()).count() == 0
    assert benchmark_hits(none, bench).count() == 0
    cut = {r.doc_id: r.text for r in remove_benchmark(docs, bench, remove="spans").collect()}
    assert cut[9] == "" and cut[1] is None and cut[15] == _texts()[15]
    assert remove_benchmark(docs, bench).columns == docs.columns


def test_language(docs, none, spark):
    model = train_prototypes(docs)
    assert set(model) == {"xx"}
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs, model).collect()}
    assert {d for d, (lang, _) in got.items() if lang == "und"} == {1, 2, 3, 18, 19}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert train_prototypes(none) == {}
    assert {r.lang_pred for r in identify_languages(docs, {}).collect()} == {"und"}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(d, int(d % 2), 0) for d in _texts()] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    weights = train(docs, labels, F.lit(True), settings=Settings(bits=12, shards=2))
    got = score_documents(docs, weights).collect()
    assert len(got) == len(_texts()) and all(0 <= r.score <= 1 for r in got)
    score = {r.row.doc_id: r.score for r in got}
    assert score[15] > score[12] and score[1] == score[2]
    assert not train(docs, labels.limit(0), F.lit(True)).any()
    assert score_documents(none, weights).count() == 0


def test_personal_data(spark, none):
    assert base_spans(None) == [] and base_spans("") == []
    assert base_spans("a@b.c, x@y 1.2.3.4 1.2.3.400 @q.r") == [("email", 0, 5), ("ip", 11, 18)]
    assert base_spans("a@b@c.de") == [("email", 2, 8)]
    assert base_spans("4111 1111 1111 1111 and +1 (705) 555-5512") == [("card", 0, 19), ("phone", 24, 41)]
    assert base_spans("1" * 50_000) == [] and base_spans("x" * 50_000 + "@") == []
    key = lambda i: f"{i * 2654435761 % 2**32:08x}" * 4
    rows = [(i, f"call the token = {key(i)} now", "q") for i in range(1, 20)] + [(90, "so token = QX-4411-9087 here", "q"), (91, None, "q"), (92, "the 990411 end", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.row.doc_id: r for r in find_personal_data(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[90].found] == [("id", 11, 23)]
    assert got[91].found == [] and got[92].found == [] and got[91].base == []
    assert find_personal_data(none).count() == 0


def test_segmentation(spark, docs, none):
    rows = sample_segmentations(docs, MODEL, k=3).select("row.doc_id", "row.text", "samples").collect()
    drawn = {r.doc_id: r.samples for r in rows}
    assert drawn[1] == [] and [list(s.ids) for s in drawn[2]] == [[]]
    assert all(len({tuple(s.ids) for s in x}) == len(x) for x in drawn.values())
    assert len(drawn[18]) == 1 and drawn[18][0].inclusion == 1  # bytes only
    assert len(drawn[3]) == 2  # two blanks, together or apart
    assert all(len(x) == 3 for d, x in drawn.items() if d not in (1, 2, 3, 18))
    one = sample_segmentations(docs, MODEL, k=3).select("row.doc_id", "row.text", F.explode("samples.ids").alias("ids"))
    assert all(r.decoded == r.text for r in decode(one, MODEL).collect())
    again = {r.doc_id: r.samples for r in sample_segmentations(docs.repartition(1), MODEL, k=3).select("row.doc_id", "samples").collect()}
    assert again == drawn
    assert sample_segmentations(none, MODEL).count() == 0
