"""The stages of the corpus pipeline against brute force, stage after stage."""

from __future__ import annotations

import math
import zlib

import numpy as np

import corpus_pipeline as P
from pairloom.llm.queries import MODEL
from pairloom.llm.segmentation import decode
from pairloom.llm.tables import stored, table
from tests.llm import brute
from tests.llm.test_floors import bundle


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def spoken_texts(docs):
    """Texts with a letter whose cosine is a quarter of the median of their length, or more."""
    rows = [(r.doc_id, r.text, r.lang, bundle(r.text)) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    trained = [x for x in rows if x[2] is not None and zlib.crc32(str(x[0]).encode()) % 3 != 1]
    sums = {lang: sum(v for _, _, other, v in trained if other == lang) for lang in {x[2] for x in trained}}
    units = np.stack([v / np.linalg.norm(v) for v in sums.values()])
    score = {d: max(0.0, float((units @ v).max() / np.linalg.norm(v))) for d, _, _, v in rows}
    letters = {d: int(math.log2(sum(c.isalpha() for c in t))) for d, t, *_ in rows}
    by_length = {}
    for d, *_ in trained:
        by_length.setdefault(letters[d], []).append(score[d])
    floor = {n: sorted(s)[(len(s) + 1) // 2 - 1] / 4 if n >= 5 else 0 for n, s in by_length.items()}
    return {d: t for d, t, *_ in rows if score[d] >= floor.get(letters[d], 0)}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = _texts(docs)

    spoken = stored(P.language_id(spark, docs, sf), "t-lang")
    kept = _texts(spoken)
    assert kept == spoken_texts(docs)
    assert spoken.columns == docs.columns

    lines = stored(P.line_dedup(spark, spoken, sf), "t-lines")
    expected = {d: x[2] for d, x in brute.repeated_lines(kept).items() if x[1] == 0 or x[1] < x[0]}
    kept = _texts(lines)
    assert kept == expected
    assert lines.dtypes == docs.dtypes or [c for c, _ in lines.dtypes] == docs.columns

    near = stored(P.jaccard_join(spark, lines, sf), "t-near")
    expected = {d: kept[d] for d, c in brute.near_components(kept).items() if c == d}
    kept = _texts(near)
    assert kept == expected

    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    clean = stored(P.decontamination(spark, near, sf), "t-clean")
    expected = {}
    for d, t in kept.items():
        n, hit, _ = brute.contamination(t, items)
        if not (hit > 0 and 20 * hit >= n):
            expected[d] = t
    kept = _texts(clean)
    assert kept == expected
    assert 0 < len(kept) < len(before)

    pieces = P.segmentation(spark, clean, sf)
    rows = decode(pieces, MODEL).collect()
    assert {r.doc_id for r in rows} == set(kept)
    assert all(r.decoded == kept[r.doc_id] for r in rows)
    whole = P.run(spark, sf)
    assert sorted((r.doc_id, r["sample"], r.ids) for r in whole.collect()) == sorted((r.doc_id, r["sample"], r.ids) for r in rows)
