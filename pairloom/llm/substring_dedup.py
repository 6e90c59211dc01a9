"""Repeated word runs across documents, by seed and extend.

Documents meet on winnowed anchors: the smallest hash of five consecutive words in every
window of thirteen. A stretch of windows around an anchor that has the same content in
several documents is decided at once. Where the surroundings differ, the match is extended
from the anchor both ways: every window that holds the anchor is compared across the
documents of its anchor. Covered windows are merged to maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import anchors, scan
from pairloom.llm.tables import stored

WINDOW, SEED = 13, 5
RESULT = "n_words long, n_removed long, runs array<struct<start:int,end:int>>, kept_text string"


def _decide(group: np.ndarray, new_content: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Later documents of equal contents go. Where an anchor has several contents and
    several documents, the first document of each content stays open."""
    run = np.cumsum(new_content) - 1
    first = doc[np.flatnonzero(new_content)][run]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))[group]
    return doc > first, (doc == first) & several & (anchors.group_sums(group, new_content) > 1)


def _cut(columns: Iterator[tuple[pa.Array, pa.Array]], window: int) -> Iterator[pa.Array]:
    for texts, spans in columns:
        data_all, offsets_all = scan.utf8(texts)
        lists = spans.to_pylist()
        n_words, n_removed, runs, kept = [], [], [], []
        for i, j in scan.blocks(offsets_all):
            data = data_all[offsets_all[i] : offsets_all[j]]
            starts, ends, firsts = scan.words(data, offsets_all[i : j + 1] - offsets_all[i], scan.PLAIN)
            raw = data.tobytes()
            for row in range(i, j):
                a, b = int(firsts[row - i]), int(firsts[row - i + 1])
                words = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                gone = covered(lists[row], b - a, window)
                n_words.append(b - a)
                runs.append([{"start": x, "end": y} for x, y in zip(*edges(gone), strict=True)])
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
        yield pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(kept, pa.string()),
            ],
            names=["n_words", "n_removed", "runs", "kept_text"],
        )


def covered(spans: list[dict] | None, n: int, window: int) -> np.ndarray:
    """Which of n units lie under the windows of the spans."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        end = s["pos"] + s["n"] + window - 1
        if end <= n:
            change[s["pos"]] += 1
            change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def edges(mask: np.ndarray) -> tuple[list[int], list[int]]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()


def remove_repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_removed``, the maximal removed ``runs`` (word
    numbers, end exclusive) and ``kept_text``, the kept words joined by one space.

    A word goes if it lies in a window whose words also stand in a document with a smaller
    id; windows are judged on the input. Null text has no words. Rows without an id lose
    nothing and make nothing go. Rows that share an id are one document and have no
    repeats of each other. Only the two named columns are read. Ids are integers.
    """
    cut = anchors.Cut(window, seed, anchors.word_units)
    texts = anchors.texts_of(docs, id_col, text_col)
    heavy = anchors.heavy_anchors(texts, cut)
    found = stored(anchors.groups_by_anchor(anchors.stretches(texts, cut, heavy), _decide), "anchored")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums, _, first, n, doc, base, h in anchors.open_stretches(batch, cut):
                yield anchors.window_rows(sums, first, n, doc, base, h.view(np.uint64), cut)

    windows = anchors.cut_by_document(texts, found.filter("open").drop("open")).mapInArrow(extend, "w1 long, w2 long, doc long, pos int")
    if len(heavy):
        windows = windows.unionByName(anchors.heavy_windows(texts, cut, heavy))
    first = (
        windows.groupBy("w1", "w2").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).filter("_first != _last")
    )
    marks = windows.join(first, ["w1", "w2"]).filter("doc > _first").select("doc", "pos", F.lit(1).alias("n"))
    spans = found.filter("not open").select("doc", "pos", "n").unionByName(marks)

    def cut_texts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _cut(columns, window)

    out = anchors.cut_by_document(texts, spans)
    out = out.withColumn("_r", F.arrow_udf(cut_texts, RESULT).asNondeterministic()("text", "spans"))
    return out.select(F.col("doc").alias(id_col), "_r.*")
