"""Ranked lexical search for many queries at once, by common subexpressions.

A query's score is a sum over its terms, so queries that share terms share partial sums.
The terms that always occur together in the same queries, and then pairs of such sets that
several queries hold, are mined into a graph of sums. A task materialises the accumulator
of every shared set once for a chunk of documents and combines accumulators along the
graph to the scores of all queries.

Documents are cut into terms once; what is written of each is its length and the terms
that some query holds. Queries come in blocks of bounded size, so neither driver nor
broadcast grows with their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm import scan
from pairloom.llm.tables import stored

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of query text in a block (a longer query is a block of its own).
BLOCK_BYTES = 4 << 20
#: A text above this is cut into terms piece by piece.
LONG = 4 << 20
#: Numbers in the accumulators of one chunk of documents.
CELLS = 1 << 20
#: Pairs of shared sets that one round of mining looks at. Fewer make longer sums, no
#: other result.
MINED_PAIRS = 4_000_000
SALTS = 32
NO_ID = (1 << 63) - 1

POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
BEST = "item_no bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())  # bytes: only A-Z have a lower case


@dataclass
class Plan:
    """Sums to be made in order. Accumulators 0 .. are the leaves (a term taken a number of
    times), then one per sum; ``items`` names the accumulators whose sum is a score."""

    leaf_term: np.ndarray
    leaf_count: np.ndarray
    sums: list[np.ndarray]
    items: list[np.ndarray]

    @property
    def size(self) -> int:
        return len(self.leaf_term) + len(self.sums)


def _pairs(items: list[set[int]], limit: int) -> Counter:
    found: Counter = Counter()
    for columns in sorted(items, key=len):
        limit -= len(columns) * (len(columns) - 1) // 2
        if limit < 0:
            break
        ordered = sorted(columns)
        found.update((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :])
    return found


def share(items: list[Counter], pair_limit: int = MINED_PAIRS) -> Plan:
    """Mine the term sets that several items share. ``items`` count term numbers."""
    leaves: dict[tuple[int, int], int] = {}
    holders = defaultdict(list)
    for i, counts in enumerate(items):
        for leaf in sorted(counts.items()):
            holders[leaves.setdefault(leaf, len(leaves))].append(i)
    sums: list[np.ndarray] = []
    columns: list[set[int]] = [set() for _ in items]
    alone: list[list[int]] = [[] for _ in items]

    def node(children) -> int:
        sums.append(np.array(sorted(children)))
        return len(leaves) + len(sums) - 1

    # Terms with the same items are one set.
    together = defaultdict(list)
    for leaf, held in holders.items():
        together[tuple(held)].append(leaf)
    for held, members in together.items():
        if len(held) == 1:
            alone[held[0]].extend(members)
            continue
        column = members[0] if len(members) == 1 else node(members)
        for i in held:
            columns[i].add(column)
    # Sets that several items hold side by side become one, best first, until none is left.
    while True:
        used, merged = set(), {}
        for (a, b), n in sorted(_pairs(columns, pair_limit).items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if a not in used and b not in used:
                used |= {a, b}
                merged[a] = (b, node((a, b)))
        if not merged:
            break
        for held in columns:
            for a in [a for a in held if a in merged and merged[a][0] in held]:
                held -= {a, merged[a][0]}
                held.add(merged[a][1])
    leaf_term, leaf_count = (np.array(x, np.int64) for x in (zip(*leaves, strict=True) if leaves else ((), ())))
    return Plan(leaf_term, leaf_count, sums, [np.array(sorted(c) + a, np.int64) for c, a in zip(columns, alone, strict=True)])


def _words(data: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of all terms (-1: not in it), and each row's first term."""
    data = scan.LOWER[data]
    starts, ends, firsts = scan.words(data, offsets, scan.ALNUM)
    flat = data[scan.ALNUM[data]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)])
    return pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(), firsts


def _pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end between two terms."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data) and scan.ALNUM[scan.LOWER[data[hi]]]:
            hi += 1
        yield lo, hi
        lo = hi


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, long: int) -> Iterator[pa.RecordBatch]:
    size = len(vocabulary)

    def rows(ids, n, row, term, tf):
        keep = n > 0
        number = np.cumsum(keep) - 1
        at = np.searchsorted(number[row], np.arange(int(keep.sum()) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (term.astype(np.int32), tf.astype(np.int64))]
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.array(n[keep].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    for batch in batches:
        ids, (data, at) = batch.column(0), scan.utf8(batch.column(1))
        for i, j in scan.blocks(at):
            part = data[at[i] : at[j]]
            if j == i + 1 and len(part) > long:
                n, tf = 0, np.zeros(size, np.int64)
                for lo, hi in _pieces(part, long):
                    found, _ = _words(part[lo:hi], np.array([0, hi - lo]), vocabulary)
                    n += len(found)
                    tf += np.bincount(found[found >= 0], minlength=size)
                term = np.flatnonzero(tf)
                yield rows(ids.slice(i, 1), np.array([n]), np.zeros(len(term), np.int64), term, tf[term])
                continue
            found, firsts = _words(part, at[i : j + 1] - at[i], vocabulary)
            n = np.diff(firsts)
            row = np.repeat(np.arange(j - i), n)
            keys, tf = np.unique(row[found >= 0] * size + found[found >= 0], return_counts=True)
            yield rows(ids.slice(i, j - i), n, keys // max(size, 1), keys % max(size, 1), tf)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 25 + 75 * n * n_docs // n_terms


class _Best:
    """The best ``k`` documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a row per item, a column per document."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, docs[at]), (self.score, scores[item, at])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        keep = place < self.k
        self.least[item[place == self.k - 1]] = score[place == self.k - 1]
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def _rank(batches: Iterator[pa.RecordBatch], plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, numbers: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of this task for every item."""
    n_leaves = len(plan.leaf_term)
    by_term = np.argsort(plan.leaf_term, kind="stable")
    leaf_at = np.searchsorted(plan.leaf_term[by_term], np.arange(len(weights) + 1))
    best = _Best(len(plan.items), k)
    width = max(8, CELLS // max(plan.size + len(plan.items), 1))
    for batch in batches:
        docs, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        at = batch.column(2).offsets.to_numpy().astype(np.int64)
        term, tf = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (2, 3))
        norm = length_norm(n.astype(np.int64), n_docs, n_terms)
        for lo in range(0, len(docs), width):
            hi = min(lo + width, len(docs))
            t, f = term[at[lo] : at[hi]], tf[at[lo] : at[hi]]
            doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            value = weights[t] * ((1_000_000_000 * f) // (1000 * f + 8 * norm[lo:hi][doc]))
            acc = np.zeros((plan.size, hi - lo), np.int64)
            uses = leaf_at[t + 1] - leaf_at[t]
            each = np.repeat(np.arange(len(t)), uses)
            local = np.arange(len(each)) - np.repeat(np.cumsum(uses) - uses, uses)
            leaf = by_term[leaf_at[t[each]] + local]
            acc[leaf, doc[each]] = plan.leaf_count[leaf] * value[each]
            for i, children in enumerate(plan.sums):
                acc[children].sum(axis=0, out=acc[n_leaves + i])
            scores = np.zeros((len(plan.items), hi - lo), np.int64)
            for i, children in enumerate(plan.items):
                acc[children].sum(axis=0, out=scores[i])
            best.add(docs[lo:hi], scores)
    yield pa.RecordBatch.from_arrays([pa.array(numbers[best.item]), pa.array(best.doc), pa.array(best.score)], names=["item_no", "doc_id", "score"])


def _top(df: DataFrame, k: int, *by) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _ranked(docs: DataFrame, items: list, k: int, long: int) -> DataFrame:
    """``item_no, rank, doc_id, score`` for a block of items."""
    spark = docs.sparkSession
    said = [Counter(terms_of(r.text)) for r in items]
    words = sorted(set().union(*said))
    number = {w: i for i, w in enumerate(words)}
    plan = share([Counter({number[w]: n for w, n in c.items()}) for c in said])
    numbers = np.array([r.item_no for r in items], np.int64)
    vocabulary = spark.sparkContext.broadcast(words)
    cut = docs.mapInArrow(lambda b: _postings(b, pa.array(vocabulary.value, pa.large_binary()), long), POSTINGS)
    postings = stored(cut, "postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not words:
        return spark.createDataFrame([], "item_no bigint, rank int, doc_id bigint, score bigint")
    weights = np.zeros(len(words), np.int64)
    for t, df in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sent = spark.sparkContext.broadcast((plan, weights, numbers))
    held = postings.filter(F.size("terms") > 0)

    def rank(batches):
        plan, weights, numbers = sent.value
        return _rank(batches, plan, weights, n_docs, n_terms, numbers, k)

    best = held.mapInArrow(rank, BEST).withColumn("_salt", F.spark_partition_id() % SALTS)
    return _top(_top(best, k, "item_no", "_salt").drop("rank"), k, "item_no").select("item_no", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    long: int = LONG,
) -> DataFrame:
    """The ``k`` best documents for every item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z
    lower-cased. A term weighs floor(1000 ln((2N+2)/(2df+1))); the score adds weight times
    (10^9 tf) div (1000 tf + 8 m) over the item's terms, repeats included, where m is
    25 + (75 n N) div L, in whole numbers. Only scores above 0 count; equal ones are ordered
    by ``doc_id``.

    A null or empty text has no term: such documents are not counted, such items get no
    row. Every row is a document or an item of its own, repeated ids included; a null
    ``doc_id`` (an integer column) comes last among equals. Other columns are ignored, and empty
    tables give no row. Items are handled in blocks of about ``block_bytes`` of text (by
    the whole item), one after the other; each block reads the documents once.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    asked = stored(asked.withColumn("item_no", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_bytes))
    results = []
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == b)
        found = _ranked(named, block.collect(), k, long)
        results.append(stored(found, "ranked") if n_blocks > 1 else found)
    found = reduce(DataFrame.unionByName, results)
    id_ = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(kind).alias("doc_id")
    return found.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", id_, "score")
