"""Benchmark passages in training texts.

The normalised windows of the benchmark become a set of hashes, sent to every executor in
blocks of a checked size. Each task scans the windows of its documents against the set and
compares the words of every hit, so a chance hash match cannot mark anything.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from pairloom.llm import scan
from pairloom.llm.tables import stored

WINDOW = 13
#: Bytes of benchmark text whose windows go to the executors at once.
BLOCK_BYTES = 8 << 20
FOUND = "n_words long, hits array<int>, items array<bigint>"
FILTER_BITS = 22


class Windows:
    """Windows of some benchmark items: sorted hashes per length, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.items: dict[bytes, set] = defaultdict(set)
        hashes: dict[int, set] = defaultdict(set)
        for item_id, text in items:
            data = scan.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = scan.words(data, np.array([0, len(data)]), scan.ALNUM)
            if not len(starts):
                continue
            n = min(size, len(starts))
            for i, h in enumerate(scan.grams(scan.Sums(data).of(starts, ends), n).tolist()):
                hashes[n].add(h)
                self.items[words_at(data, starts, ends, i, n)].add(item_id)
        self.items = dict(self.items)
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in sorted(hashes.items())}
        self.filters = {}
        for n, h in self.hashes.items():
            self.filters[n] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[n][h >> np.uint64(64 - FILTER_BITS)] = True


def words_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True))


def find(column: pa.Array, known: Windows) -> pa.Array:
    """Per text the number of words, the hit word numbers and the items that occur."""
    n_words, hits, items = [], [], []
    data_all, offsets_all = scan.utf8(column)
    for i, j in scan.blocks(offsets_all):
        offsets = offsets_all[i : j + 1] - offsets_all[i]
        data = scan.LOWER[data_all[offsets_all[i] : offsets_all[j]]]
        starts, ends, firsts = scan.words(data, offsets, scan.ALNUM)
        hashes = scan.Sums(data).of(starts, ends)
        found: dict[int, tuple[list, set]] = {}
        for n, set_ in known.hashes.items():
            h = scan.grams(hashes, n)
            at = np.flatnonzero(known.filters[n][h >> np.uint64(64 - FILTER_BITS)])
            at = at[np.isin(h[at], set_)]
            for w in at.tolist():
                row = int(np.searchsorted(firsts, w, side="right")) - 1
                if w + n > firsts[row + 1]:
                    continue
                which = known.items.get(words_at(data, starts, ends, w, n))
                if which:
                    cover, seen = found.setdefault(row, ([], set()))
                    cover.append((w - int(firsts[row]), n))
                    seen |= which
        counts = np.diff(firsts)
        for row in range(j - i):
            n_words.append(int(counts[row]))
            cover, seen = found.get(row, ((), ()))
            hits.append(sorted({p for w, n in cover for p in range(w, w + n)}))
            items.append(sorted(x for x in seen if x is not None))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
        names=["n_words", "hits", "items"],
    )


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[int, Iterator[list]]:
    """How many blocks of about ``limit`` bytes the items make, and the blocks, one at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // limit))
    mine = lambda b: rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
    return n, ([(r.i, r.t) for r in mine(b).collect()] for b in range(n))


def _scanner(known: Broadcast):
    """Marked as not deterministic, so that a filter on the result does not run it twice."""

    def scan_block(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield find(batch, known.value)

    return F.arrow_udf(scan_block, FOUND).asNondeterministic()


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``; ``n_words``; ``hits``, the numbers of
    the words inside a benchmark window; ``items``, the ids of the items that occur, both sorted.

    A window is ``size`` consecutive words of an item; an item with fewer words is one
    window, an item without words is none. Null text has no words. An item without an id
    marks words and is not listed. An empty benchmark marks nothing. A benchmark beyond
    ``block_bytes`` is sent and scanned block after block; the hits of each are written, so
    driver and executors hold one block at a time.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    context = docs.sparkSession.sparkContext
    n_blocks, blocks = _blocks_of(benchmark, item_col, item_text_col, block_bytes)
    if n_blocks == 1:
        found = rows.withColumn("_f", _scanner(context.broadcast(Windows(next(blocks), size)))(text))
        return found.select("row", "_f.n_words", "_f.hits", "_f.items")
    rows = stored(rows.withColumn("_n", F.monotonically_increasing_id()), "scanned")
    parts = []
    for k, block in enumerate(blocks):
        known = context.broadcast(Windows(block, size))
        one = rows.select("_n", _scanner(known)(text).alias("_f")).select("_n", "_f.*")
        parts.append(stored(one if k == 0 else one.filter(F.size("hits") > 0), "hits"))
        known.destroy()
    in_order = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    united = reduce(DataFrame.unionByName, parts).groupBy("_n").agg(F.max("n_words").alias("n_words"), in_order("hits"), in_order("items"))
    return rows.join(united, "_n").select("row", "n_words", "hits", "items")


def is_contaminated(share: int = 20) -> Column:
    """The rule on the columns of ``benchmark_hits``: at least 1/share of the words are hit."""
    n_hit = F.size("hits").cast("long")
    return (n_hit > 0) & (n_hit * share >= F.col("n_words"))


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for text, hit in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
        if text and hit:
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = scan.words(scan.LOWER[data], np.array([0, len(data)]), scan.ALNUM)
            keep = np.ones(len(data), bool)
            runs = np.split(np.array(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
            for run in runs:
                keep[starts[run[0]] : ends[run[-1]]] = False
            text = data[keep].tobytes().decode()
        out.append(text)
    return pa.array(out, pa.string())


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without contaminated documents, or with every run of hit words cut out."""
    found = benchmark_hits(docs, benchmark, text_col=text_col, **kw)
    if remove == "documents":
        return found.filter(~is_contaminated()).select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.col("row").getField(text_col)
    return found.select(F.col("row").withField(text_col, _cut(text, F.col("hits"))).alias("row")).select("row.*")


def items_digest() -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return F.sha2(F.array_join(ids, ","), 256)
