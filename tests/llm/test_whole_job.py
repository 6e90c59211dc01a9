"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from pairloom.llm.decontamination import benchmark_hits, remove_benchmark
from pairloom.llm.pii import instances
from pairloom.llm.queries import SAMPLES, op8_sentencepiece


def _words(n, seed, alphabet=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(alphabet)}" for _ in range(n))


def test_benchmark_spans_do_not_depend_on_blocks(spark):
    passages = {i: _words(13, 200 + i) for i in range(6)}
    bench = spark.createDataFrame(list(passages.items()), "item_id long, text string")
    r, rows = random.Random(5), []
    for d in range(30):
        order = r.sample(sorted(passages), 6)
        rows.append((d, " ".join(f"out{d} {passages[i]} more" for i in order)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    cut = {}
    for size in (1 << 20, 100):  # one block, and several
        found = benchmark_hits(docs, bench, block_bytes=size).collect()
        assert all(list(x.hits) == sorted(x.hits) and list(x["items"]) == sorted(passages) for x in found)
        cut[size] = {x.doc_id: x.text for x in remove_benchmark(docs, bench, remove="spans", block_bytes=size).collect()}
    assert cut[100] == cut[1 << 20] == {d: " ".join([f"out{d}  more"] * 6) for d in range(30)}


def test_long_tokens_are_whole_nodes():
    """Shapes and context words that differ only after their 64th character are different."""
    stem = "a1" * 40
    shapes, patterns = set(), set()
    for tail in ("-", "_", "-_", "--"):
        shapes.add(instances(f"key {stem}{tail}9 end", [])[0][2])
        patterns.add(tuple(instances(f"{'https://x.y/' + 'b' * 60}{tail} 123456 end", [])[0][4]))
    assert len(shapes) == len(patterns) == 4
    assert all(len(x) < 100 for x in shapes)
    # Digits are alike in a context word, wherever they stand.
    assert instances(f"{'w' * 70}12 123456", [])[0][4] == instances(f"{'w' * 70}7 123456", [])[0][4]
    assert instances("key 123456-ab end", [])[0][2] == "9+-a+"


def test_sentencepiece_gives_ids_and_decodes_them(spark, tmp_path):
    texts = {1: None, 2: "", 3: _words(50, 1), 4: "\u00e4\u00f6\u00fc \u2603  \u6f22\u5b57\n\n", 5: " the\tend "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_sentencepiece(spark, str(tmp_path)).collect()
    by_doc = {d: [r for r in rows if r.doc_id == d] for d in texts}
    assert {d: len(x) for d, x in by_doc.items()} == {1: 1, 2: 1, 3: SAMPLES, 4: SAMPLES, 5: SAMPLES}
    gone = by_doc[1][0]
    assert (gone["sample"], gone.n_pieces, gone.ids, gone.decoded_sha256, gone.round_trip) == (None,) * 5
    for r in rows:
        if r.doc_id != 1:
            assert len(r.ids) == r.n_pieces and r.round_trip
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_stage_keeps_text_when_nothing_was_learned(spark):
    texts = ["plain words", "\u6f22\u5b57", "", None, "12 -- ?"] * 6
    docs = spark.createDataFrame([(d, t, None) for d, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {d for d, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert kept.columns == docs.columns
