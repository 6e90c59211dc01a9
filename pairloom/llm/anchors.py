"""Repeated windows of a fixed length, found through winnowed anchors.

A window is ``window`` consecutive units (bytes or words). Its anchor is the run of
``seed`` units inside it with the smallest hash, so equal windows have equal anchors at the
same place. Neighbouring windows with the same anchor form a stretch. Stretches, a small
fraction of all windows, are all that is shuffled: as the hash of the anchor, the hash of
the content, the document and the place.

Sorted by anchor, a group of stretches falls into three cases: one stretch only, which
repeats nothing; equal contents, which are decided at once; different contents around one
anchor, which are left open for the operator to extend and compare.

Anchors that hold more than a set share of all stretches are found beforehand with a
summary of bounded size. Their windows are hashed one by one and counted with a partial
sum in every task, so no group of any size has to come together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import scan
from pairloom.llm.tables import partitions

#: Windows per stretch are packed below this factor.
PACK = 1 << 10
PLACE_BITS = 24
ROWS_AT_ONCE = 1 << 18
HEAVY_PER_PARTITION = 1

STRETCH = "h long, c long, doc long, at long"


@dataclass(frozen=True)
class Cut:
    """How texts are cut into units and windows. ``units`` gives the values of a block of
    bytes and the unit offsets of its rows."""

    window: int
    seed: int
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

    def __post_init__(self):
        if not 0 < self.window - self.seed < PACK - 1:
            raise ValueError("the seed must be shorter than the window")


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = scan.words(data, offsets, scan.PLAIN)
    return scan.Sums(data).of(starts, ends), firsts


class Stretches:
    """The stretches of a block: anchor hash, row, first window (unit number in the block)
    and number of windows."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, cut: Cut):
        self.sums = scan.Sums(values)
        n = len(values) - cut.window + 1
        if n <= 0:
            self.h = np.empty(0, np.uint64)
            self.row = self.first = self.size = np.empty(0, np.int64)
            return
        seeds = self.sums.every(cut.seed)
        anchor = np.empty(n, np.int64)
        tile = 1 << (PLACE_BITS - 1)
        for a in range(0, n, tile):
            b = min(n, a + tile)
            anchor[a:b] = a + _first_smallest(seeds[a : b + cut.window - cut.seed], cut.window - cut.seed + 1)
        bad = np.zeros(len(values) + 1, np.int64)
        ends = offsets[1:]
        np.add.at(bad, np.maximum(offsets[:-1], ends - cut.window + 1), 1)
        np.add.at(bad, ends, -1)
        good = np.cumsum(bad)[:n] == 0
        new = np.ones(n + 1, bool)
        new[1:-1] = anchor[1:] != anchor[:-1]
        was = np.concatenate([[False], good[:-1]])
        will = np.concatenate([good[1:], [False]])
        self.first = np.flatnonzero(good & (new[:-1] | ~was))
        last = np.flatnonzero(good & (new[1:] | ~will))
        self.size = last - self.first + 1
        self.h = seeds[anchor[self.first]]
        self.row = np.searchsorted(offsets, self.first, side="right") - 1


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of the smallest, the first of equals."""
    key = (values & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def _blocks(batch: pa.RecordBatch, cut: Cut) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, unit values, unit offsets and raw bytes of each block of a batch (doc, text)."""
    ids = batch.column(0)
    texts = batch.column(1)
    if ids.null_count:
        texts = texts.filter(ids.is_valid())
        ids = ids.drop_null()
    ids = ids.to_numpy(zero_copy_only=False)
    data, offsets = scan.utf8(texts)
    for i, j in scan.blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        values, firsts = cut.units(part, offsets[i : j + 1] - offsets[i])
        yield ids[i:j], values, firsts, part


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, text``. A row without an id or a text has no windows."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def heavy_anchors(texts: DataFrame, cut: Cut, per_partition: int = HEAVY_PER_PARTITION) -> np.ndarray:
    """Sorted hashes of all anchors with more than 1/k of the stretches, k being
    ``per_partition`` times the shuffle partitions, and none with less than 1/(2k); so at
    most 2k of them, whatever the input. Each task keeps a summary of 4k anchors."""
    k = per_partition * partitions(texts.sparkSession)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            for _, values, offsets, _ in _blocks(batch, cut):
                h, n = np.unique(Stretches(values, offsets, cut).h, return_counts=True)
                total += int(n.sum())
                keys, inverse = np.unique(np.concatenate([keys, h]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 4 * k:
                    counts -= np.partition(counts, len(counts) - 4 * k - 1)[len(counts) - 4 * k - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
        keys, counts = keys[counts >= total / (4 * k)], counts[counts >= total / (4 * k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([total, *counts.tolist()], pa.int64())],
            names=["h", "n"],
        )

    found = texts.mapInArrow(summary, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n")).limit(2 * k + 1).collect()
    whole = next((r.n for r in rows if r.h is None), 0)
    return np.sort(np.array([r.h for r in rows if r.h is not None and r.n * 2 * k >= whole], np.int64).view(np.uint64))


def stretches(texts: DataFrame, cut: Cut, heavy: np.ndarray) -> DataFrame:
    """One row per stretch whose anchor is not heavy."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values, offsets, _ in _blocks(batch, cut):
                s = Stretches(values, offsets, cut)
                keep = ~np.isin(s.h, heavy) if len(heavy) else slice(None)
                first, size, row = s.first[keep], s.size[keep], s.row[keep]
                content = s.sums.of(first, first + size + (cut.window - 1))
                at = (first - offsets[row]) * PACK + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (s.h[keep].view(np.int64), content.view(np.int64), ids[row], at)],
                    names=["h", "c", "doc", "at"],
                )

    return texts.mapInArrow(emit, STRETCH)


def heavy_windows(texts: DataFrame, cut: Cut, heavy: np.ndarray) -> DataFrame:
    """One row ``w1, w2, doc, pos`` per window whose anchor is heavy."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values, offsets, _ in _blocks(batch, cut):
                s = Stretches(values, offsets, cut)
                keep = np.isin(s.h, heavy)
                yield window_rows(s.sums, s.first[keep], s.size[keep], ids[s.row[keep]], offsets[s.row[keep]], s.h[keep], cut)

    return texts.mapInArrow(emit, "w1 long, w2 long, doc long, pos int")


def window_rows(sums: scan.Sums, first: np.ndarray, size: np.ndarray, doc: np.ndarray, base: np.ndarray, h: np.ndarray, cut: Cut) -> pa.RecordBatch:
    """Every window of the given stretches as a 128-bit hash, the anchor's among it."""
    owner = np.repeat(np.arange(len(first)), size)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    w1 = sums.of(start, start + cut.window)
    half = cut.window // 2
    w2 = scan.mix(sums.of(start, start + half) ^ (sums.of(start + half, start + cut.window) * np.uint64(3)) ^ h[owner])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(w1.view(np.int64)),
            pa.array(w2.view(np.int64)),
            pa.array(doc[owner]),
            pa.array((start - base[owner]).astype(np.int32)),
        ],
        names=["w1", "w2", "doc", "pos"],
    )


def groups_by_anchor(rows: DataFrame, decide: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Bring stretches with the same anchor together and decide them.

    ``decide`` gets sorted arrays (anchor groups as numbers, content runs as numbers, doc,
    at) and returns masks of the rows to remove and of the rows to leave open. The result
    has ``h, doc, pos, n, open`` for those rows. The anchors come sorted, so a task holds
    some hundred thousand rows at a time.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, doc, at in sorted_groups(batches):
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(new_h) - 1
            gone, left = decide(group, new_c, doc, at)
            keep = np.flatnonzero(gone | left)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[keep]),
                    pa.array(doc[keep]),
                    pa.array((at[keep] // PACK).astype(np.int32)),
                    pa.array((at[keep] % PACK).astype(np.int32)),
                    pa.array(left[keep]),
                ],
                names=["h", "doc", "pos", "n", "open"],
            )

    dealt = rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "c", "doc", "at")
    return dealt.mapInArrow(emit, "h long, doc long, pos int, n int, open boolean")


def sorted_groups(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first one, cut only between its values."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        count += batch.num_rows
        if count < rows:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        end = int(np.searchsorted(whole[0], whole[0][-1]))
        if end:
            yield [x[:end] for x in whole]
        held, count = [[x[end:] for x in whole]], 0
    if held and any(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def group_sums(group: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Per row, how many rows of its group the mask has."""
    return np.bincount(group, mask, minlength=1)[group]


def cut_by_document(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with all spans (``pos, n``) of a document in one array, null where there are none.

    The texts are dealt out by an explicit partitioning, the same wherever a document has
    to meet its spans, so Spark writes that exchange once and reads it again.
    """
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "doc"])).alias("spans"))
    return texts.repartition(partitions(texts.sparkSession), "doc").join(by_doc, "doc", "left")


def open_stretches(batch: pa.RecordBatch, cut: Cut) -> Iterator[tuple]:
    """For each block of a batch (doc, text, spans of pos, n, h): hash sums and unit values,
    and of every stretch the first unit, the number of windows, the document, the row's
    first unit and the anchor."""
    batch = batch.filter(batch.column(2).is_valid())
    lists = batch.column(2)
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    flat = lists.flatten()
    pos, n, h = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "n", "h"))
    ends = np.concatenate([[0], np.cumsum(counts)])
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = scan.utf8(batch.column(1))
    for i, j in scan.blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        values, firsts = cut.units(part, offsets[i : j + 1] - offsets[i])
        row = np.repeat(np.arange(j - i), counts[i:j])
        mine = slice(ends[i], ends[j])
        # A row that shares its id with another may be shorter than the place asked for.
        fits = firsts[row] + pos[mine] + n[mine] + (cut.window - 1) <= firsts[row + 1]
        row, first = row[fits], (firsts[row] + pos[mine])[fits]
        yield scan.Sums(values), values, first, n[mine][fits], ids[i:j][row], firsts[row], h[mine][fits]
