"""Repeated byte strings, by a run-length index and matching statistics.

Texts are cut at winnowed anchors (see ``anchors``). Stretches of bytes that are equal in
several places are decided at once; different stretches around the same anchor are brought
together, and in each task an index over some of them is queried with the others: the
Burrows-Wheeler transform of the earlier strings, kept as runs, with the text positions of
the first and last row of every run. A string is streamed through it from its last byte to
its first. Where the next byte continues the match, the row follows from the run; where it
does not, the match jumps to the nearest run of that byte, whose sampled end says which
text it now stands for and how much of the match survives. The lengths that result are the
matching statistics, and a window is repeated where its length reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import anchors, scan
from pairloom.llm.substring_dedup import covered, edges
from pairloom.llm.tables import partitions, stored

WINDOW, SEED = 100, 24
STRINGS_AT_ONCE = 8192
#: Parts of the places that a window can have around its anchor; see ``may_share``.
PARTS = 4
RESULT = "n_bytes long, n_removed long, runs array<struct<start:int,end:int>>, kept binary"


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of strings of symbols, each ended by a
    separator of its own that sorts before all symbols."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """``symbols`` holds the strings one after the other, ``ends`` where each ends."""
        n_strings = len(ends)
        cuts = ends + np.arange(n_strings)
        text = np.full(len(symbols) + n_strings, -1, np.int64)
        body = np.ones(len(text), bool)
        body[cuts] = False
        text[body] = symbols + n_strings
        text[cuts] = np.arange(n_strings)
        rows = _suffix_order(text)
        last = text[rows - 1]  # of row 0 the final separator, which no query asks for
        self.run = np.flatnonzero(np.diff(last, prepend=-2))
        self.symbol = last[self.run]
        stop = np.append(self.run[1:], len(text))
        self.first_at, self.last_at, self.stop = rows[self.run], rows[stop - 1], stop
        order = np.argsort(self.symbol, kind="stable")
        length = (stop - self.run)[order]
        self.to = np.empty(len(order), np.int64)
        self.to[order] = np.cumsum(length) - length
        self.alphabet, code = np.unique(self.symbol, return_inverse=True)
        self.runs_by_symbol, self.code = order, code
        self.keys = code[order] * len(order) + order
        self.shift = n_strings
        self.text = text
        self.sums = scan.Sums(scan.mix(text.astype(np.uint64)))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most ``most``."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        room = np.minimum(most, len(self.text) - np.maximum(a, b))
        sums, back = self.sums.sums, self.sums.back
        while step:
            x, y = a + got, b + got
            ok = got + step <= room
            last = len(sums) - 1
            left = (sums[np.minimum(x + step, last)] - sums[x]) * back[x]
            got += step * (ok & (left == (sums[np.minimum(y + step, last)] - sums[y]) * back[y]))
            step >>= 1
        return got

    def matching_statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 40) -> np.ndarray:
        """For each place in the query strings, how long a match with the index starts there,
        counted up to ``most``."""
        out = np.zeros(len(symbols), np.int64)
        query = symbols + self.shift
        codes = np.minimum(np.searchsorted(self.alphabet, query), len(self.alphabet) - 1)
        found = self.alphabet[codes] == query
        # Longest first, so the strings that still have bytes left are a slice.
        order = np.argsort(starts - ends, kind="stable")
        ends = ends[order]
        lengths = ends - starts[order]
        wheres, rows, sizes = np.full(len(ends), self.first_at[0]), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            n = int(np.searchsorted(-lengths, -back, side="right"))
            where, row, size = wheres[:n], rows[:n], sizes[:n]
            at = ends[:n] - back
            code, known = codes[at], found[at]
            run = np.searchsorted(self.run, row, side="right") - 1
            jump = np.flatnonzero(known & (self.code[run] != code))
            if len(jump):
                m = len(jump)
                key = np.searchsorted(self.keys, code[jump] * len(self.run) + run[jump])
                here, have = where[jump], size[jump]
                # The last row of the nearest run above, the first row of the nearest below.
                near = np.concatenate([key - 1, key])
                inside = np.clip(near, 0, len(self.keys) - 1)
                r = self.runs_by_symbol[inside]
                twice = np.concatenate([code[jump], code[jump]])
                fits = (inside == near) & (self.code[r] == twice)
                at_r = np.concatenate([self.last_at[r[:m]], self.first_at[r[m:]]])
                most_here = np.where(fits, np.concatenate([have, have]), 0)
                common = np.where(fits, self._common(at_r, np.concatenate([here, here]), most_here), -1)
                up = common[:m] >= common[m:]
                pick = np.where(up, np.arange(m), np.arange(m) + m)
                run[jump], where[jump] = r[pick], at_r[pick]
                size[jump] = np.maximum(0, common[pick])
                row[jump] = np.where(up, self.stop[r[pick]] - 1, self.run[r[pick]])
            rows[:n] = np.where(known, self.to[run] + row - self.run[run], 0)
            wheres[:n] = np.where(known, where - 1, self.first_at[0])
            sizes[:n] = np.where(known, np.minimum(size + 1, most), 0)
            out[at] = sizes[:n]
        return out


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling, from as many symbols as fit a number; only suffixes
    that are still tied are sorted again. The separators differ, so no tie outlasts the
    longest common part of two strings."""
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    packed = max(1, 62 // bits)
    start = text.copy()
    packed = min(packed, n)
    for j in range(1, packed):
        start <<= bits
        start[: n - j] |= text[j:]
    order = np.argsort(start)
    ranked = start[order]
    first = np.flatnonzero(np.diff(ranked, prepend=ranked[0] - 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = order[np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))]
    step = packed
    while len(tied):
        after = np.zeros(len(tied), np.int64)
        inside = tied + step < n
        after[inside] = rank[tied[inside] + step] + 1
        key = rank[tied] * (n + 1) + after
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        old = rank[tied]
        place = np.arange(len(tied))
        group = np.flatnonzero(np.diff(old, prepend=-1))
        place -= np.repeat(group, np.diff(np.append(group, len(tied))))
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(fresh, len(tied)))
        rank[tied] = old + np.repeat(place[fresh], size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def later_windows(group: np.ndarray, strings: list[bytes], n: np.ndarray, window: int) -> np.ndarray:
    """Which windows of the strings occur in an earlier string of the same group.

    Strings come sorted by group, and in a group by document and place. Any two strings of a
    group are parted at one bit of their numbers: the ones with 0 there are indexed, the
    ones with 1 are streamed. Symbols carry the number of their part, so parts that share
    one index never match each other. Result: a mask over all windows, string after string.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    member = np.arange(len(group)) - np.searchsorted(group, group)
    first_window = np.cumsum(n) - n
    marks = np.zeros(int(n.sum()), bool)
    for bit in range(int(member.max(initial=0)).bit_length()):
        part = np.unique(np.stack([group, member >> (bit + 1)]), axis=1, return_inverse=True)[1].reshape(-1)
        asks = (member >> bit) & 1 == 1
        both = np.bincount(part, asks, minlength=1) * np.bincount(part, ~asks) > 0
        take = both[part]
        old, new = np.flatnonzero(take & ~asks), np.flatnonzero(take & asks)
        if not len(new):
            continue
        symbols = data + np.repeat(part, lengths) * 256
        inside = np.repeat(take & ~asks, lengths)
        index = RunLengthIndex(symbols[inside], np.cumsum(lengths[old]))
        sizes = index.matching_statistics(symbols, ends[new] - lengths[new], ends[new], window)
        owner = np.repeat(new, n[new])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n[new]) - n[new], n[new])
        marks[first_window[owner] + offset] |= sizes[ends[owner] - lengths[owner] + offset] >= window
    return marks


def _decide(group: np.ndarray, new_content: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All but the first place of equal contents go; the first stays open where its anchor
    has other contents too."""
    run = np.cumsum(new_content) - 1
    starts = np.flatnonzero(new_content)
    same = (doc == doc[starts][run]) & (at == at[starts][run])
    return ~same, new_content & (anchors.group_sums(group, new_content) > 1)


def _open_strings(batches: Iterator[pa.RecordBatch], cut: anchors.Cut) -> Iterator[pa.RecordBatch]:
    """The bytes of the open stretches, with their anchors."""
    for batch in batches:
        for _, data, first, n, doc, base, h in anchors.open_stretches(batch, cut):
            raw = data.tobytes()
            strings = [raw[a : a + m + cut.window - 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h),
                    pa.array(doc),
                    pa.array((first - base).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(strings, pa.binary()),
                ],
                names=["h", "doc", "pos", "n", "s"],
            )


def may_share(h: np.ndarray, strings: list[bytes], window: int, seed: int) -> np.ndarray:
    """Which strings may share a window with another string around the same anchor.

    A window holds its anchor, and equal windows hold it at the same place. These places are
    cut into ``PARTS``; all windows of a part have the bytes in common that lie between the
    latest start and the earliest end around the anchor. A string shares no window of a part
    unless another one has those bytes too. The anchor is the first run of ``seed`` bytes with
    the hash; a string without one stays.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sums = scan.Sums(np.frombuffer(b"".join(strings), np.uint8))
    anchor = h.astype(np.int64).view(np.uint64)
    there = np.flatnonzero(sums.every(seed) == np.repeat(anchor, lengths)[: len(sums.sums) - seed])
    at = np.append(there, ends[-1])[np.searchsorted(there, starts)]
    may = at + seed > ends
    edges = np.linspace(0, window - seed + 1, PARTS + 1).astype(np.int64).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        a, b = at - low, at + window + 1 - high
        mine = np.flatnonzero((a >= starts) & (b <= ends))
        key = scan.mix(sums.of(a[mine], b[mine]) ^ anchor[mine])
        order = np.argsort(key)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        may[mine[order[same]]] = may[mine[order[same + 1]]] = True
    return may


def _query_indexes(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows among strings that come sorted by anchor and place."""
    for h, *columns in anchors.sorted_groups(batches, STRINGS_AT_ONCE):
        may = may_share(h, columns[-1].tolist(), window, seed)
        if not may.any():
            continue
        h, doc, pos, n, strings = (x[may] for x in (h, *columns))
        n = n.astype(np.int64)
        group = np.cumsum(np.diff(h, prepend=h[0]) != 0)
        marks = later_windows(group, strings.tolist(), n, window)
        first = np.cumsum(n) - n
        # A run of marked windows ends with its string.
        owner = np.repeat(np.arange(len(n)), n)
        before = np.concatenate([[False], marks[:-1]])
        before[first] = False
        after = np.concatenate([marks[1:], [False]])
        after[first + n - 1] = False
        a, b = np.flatnonzero(marks & ~before), np.flatnonzero(marks & ~after)
        mine = owner[a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[mine]), pa.array((pos[mine] + a - first[mine]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))],
            names=["doc", "pos", "n"],
        )


def _cut(columns: Iterator[tuple[pa.Array, pa.Array]], window: int) -> Iterator[pa.Array]:
    for texts, spans in columns:
        data, offsets = scan.utf8(texts)
        n_bytes, n_removed, runs, kept = [], [], [], []
        for row, own in enumerate(spans.to_pylist()):
            part = data[offsets[row] : offsets[row + 1]]
            gone = covered(own, len(part), window)
            n_bytes.append(len(part))
            n_removed.append(int(gone.sum()))
            runs.append([{"start": x, "end": y} for x, y in zip(*edges(gone), strict=True)])
            kept.append(part[~gone].tobytes())
        yield pa.StructArray.from_arrays(
            [
                pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(kept, pa.binary()),
            ],
            names=["n_bytes", "n_removed", "runs", "kept"],
        )


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, the maximal removed ``runs`` (byte
    numbers, end exclusive) and the ``kept`` bytes.

    A byte goes if it lies in ``window`` bytes that also start earlier, in a document with a
    smaller id or further ahead in the same one; strings are judged on the input. Null text
    is empty. Rows without an id lose nothing and make nothing go. Rows that share an id
    are one document and have no repeats of each other. Only the two named columns are
    read. Ids are integers.
    """
    cut = anchors.Cut(window, seed, anchors.byte_units)
    texts = anchors.texts_of(docs, id_col, text_col)
    heavy = anchors.heavy_anchors(texts, cut)
    found = stored(anchors.groups_by_anchor(anchors.stretches(texts, cut, heavy), _decide), "anchored")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _open_strings(batches, cut)

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _query_indexes(batches, window, seed)

    def cut_texts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _cut(columns, window)

    near = anchors.cut_by_document(texts, found.filter("open").drop("open"))
    near = near.mapInArrow(strings, "h long, doc long, pos int, n int, s binary")
    near = near.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h", "doc", "pos")
    spans = found.filter("not open").select("doc", "pos", "n").unionByName(near.mapInArrow(query, "doc long, pos int, n int"))
    if len(heavy):
        windows = anchors.heavy_windows(texts, cut, heavy)
        place = F.struct("doc", "pos")
        first = windows.groupBy("w1", "w2").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first != _last")
        marks = windows.join(first, ["w1", "w2"]).filter(place != F.col("_first"))
        spans = spans.unionByName(marks.select("doc", "pos", F.lit(1).alias("n")))
    out = anchors.cut_by_document(texts, spans)
    out = out.withColumn("_r", F.arrow_udf(cut_texts, RESULT).asNondeterministic()("text", "spans"))
    return out.select(F.col("doc").alias(id_col), "_r.*")
