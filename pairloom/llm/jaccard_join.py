"""Near-duplicate texts by a universe-partition join on word shingles.

Two sets with a Jaccard similarity of at least 3/4 differ in at most a seventh of their
summed sizes. The universe of shingles is cut into segments by hash, as many as the size
band of a set asks for. If a set has more filled segments than differences are possible,
some segment is the same in both sets (pigeonhole), so the hash of a segment's content is
a signature that linked sets share. Three refinements:

* A set indexes only a subset of its segments, the first ones in hash order whose count
  exceeds its largest possible difference, with some to spare.
* Where a band holds so many sets that chance matches would cost more than signatures, its
  segments are coarser and their one-deletion neighbourhoods are indexed too: a segment
  with two or more shingles then matches up to one difference and counts double. A cost
  estimate decides this for each band.
* A signature with many sets is skipped for every set that has enough others; only sets
  without spare segments are compared with its members: first with one of them, then, in
  blocks, across what still are different components. All sets order their crowded
  signatures alike, so linked sets meet in the first ones of both (prefix filter), and a
  pair that shares one of the signatures just before is left to that one.

The spare segments also count: a linked pair shares one signature more than the spare ones
that it has not lost to skipped signatures, so pairs that share fewer are dropped. What is
left passes an exact bound on histograms of the shingle hashes, coarse and fine, and is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairloom.llm import scan
from pairloom.llm.anchors import sorted_groups
from pairloom.llm.components import components
from pairloom.llm.tables import partitions, stored

SHINGLE = 5
CELLS = 512
#: Up to so many sets a signature's members are all compared with each other.
FEW = 16
#: Members of a larger signature that are compared in one piece.
BLOCK = 4096
#: So many of a set's crowded signatures before one tell which pairs have met before it.
BEFORE = 4
#: So many document numbers (16 bytes each) may be sent to every executor.
BROADCAST_ROWS = 2_000_000
#: Chance that an unrelated set of the band holds a given shingle, for the cost estimate.
CHANCE = 1e-6
SMALL_BAND = 6
#: Bytes of text whose sets are made at once; their arrays take some fifty times as much.
SET_BYTES = 1 << 18
FLUSH = 1 << 18
#: Low bytes of a signature that travel; with its bucket they tell signatures apart.
SIG_BYTES = 5

INFO = "doc long, node long, check long, size long, short boolean, cells binary"
SIGNATURES = "bucket int, sig binary, node binary, size binary, band binary, units binary, spare binary"
FOUND = "g long, node long, size int, band int, units int, spare int, n int, other long, other_size int, other_spare int"
_PARTS = (("sig", np.uint64), ("node", np.int64), ("size", np.int32), ("band", np.int8), ("units", np.int8), ("spare", np.int32))


def _usual_spare(size: np.ndarray) -> np.ndarray:
    """What a set can spare that has enough segments."""
    return (size // 3 + 1) // 5 + 4


def _usual_band(size: np.ndarray) -> np.ndarray:
    return np.frexp(size.astype(np.float64))[1] - 1


def _width(name: str, kind: type) -> int:
    return SIG_BYTES if name == "sig" else np.dtype(kind).itemsize


def packed(parts: dict[str, np.ndarray], cut: np.ndarray, there: np.ndarray) -> list[pa.Array]:
    """Signatures, in the order of their buckets, as one binary value per column and bucket:
    the lowest bytes of all values, then the next ones, so that equal high bytes cost little.
    Band and spare segments are told by what is usual for the size."""
    size, columns = parts["size"], []
    told = parts | {"band": parts["band"] - _usual_band(size), "spare": _usual_spare(size) - parts["spare"]}
    for name, kind in _PARTS:
        values = told[name].astype(kind).view(np.uint8).reshape(len(size), -1)[:, : _width(name, kind)]
        columns.append(pa.array([values[cut[b] : cut[b + 1]].T.tobytes() for b in there], pa.binary()))
    return columns


def unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The signatures in rows of one bucket, whose number stands above their low bytes."""
    parts = {}
    for place, (name, kind) in enumerate(_PARTS, 1):
        data, at = scan.utf8(batch.column(place))
        width = _width(name, kind)
        values = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            values[x // width : y // width, :width] = data[x:y].reshape(width, -1).T
        parts[name] = values.reshape(-1).view(kind)
    parts["sig"] |= np.uint64(batch.column(0)[0].as_py()) << np.uint64(8 * SIG_BYTES)
    parts["band"] = (parts["band"] + _usual_band(parts["size"])).astype(np.int8)
    parts["spare"] = (_usual_spare(parts["size"]) - parts["spare"]).astype(np.int32)
    return parts


@dataclass(frozen=True)
class Plan:
    """Salt of the hashes and the bands that index one-deletion neighbourhoods."""

    salt: int = 0
    deletions: frozenset[int] = frozenset()

    def shift(self, band: np.ndarray) -> np.ndarray:
        """Bits below the segment number. Small bands give every shingle its own segment."""
        coarse = np.isin(band, list(self.deletions))
        return np.where(band < SMALL_BAND, 24, np.where(coarse, 65 - band, 63 - band)).astype(np.uint64)


def choose_deletions(sets_per_band: dict[int, int], chance: float = CHANCE) -> frozenset[int]:
    """Bands where signatures of at least two shingles, twice as many, are cheaper than
    signatures of one: cost is signatures times one plus the chance matches of each."""
    out = set()
    for band, n in sets_per_band.items():
        single, double = 1 + n * chance, 2 * (1 + n * chance * chance)
        if band >= SMALL_BAND and double < single:
            out.add(band)
    return frozenset(out)


class Sets:
    """Shingle sets of a block of texts: sorted by row and hash, without repeats."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = scan.LOWER[data]
        starts, ends, firsts = scan.words(data, offsets, scan.PLAIN)
        hashes = scan.Sums(data).of(starts, ends)
        n_rows = len(offsets) - 1
        words = np.diff(firsts)
        inside = scan.in_row(firsts, SHINGLE, len(hashes))
        row = np.repeat(np.arange(n_rows), words)
        tokens, rows = [scan.grams(hashes, SHINGLE)[inside]], [row[: len(inside)][inside]]
        for few in range(1, SHINGLE):  # shorter texts are one shingle
            mine = np.flatnonzero(words == few)
            if len(mine):
                tokens.append(scan.grams(hashes, few)[firsts[mine]])
                rows.append(mine)
        token, row = np.concatenate(tokens), np.concatenate(rows)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.token, self.row, self.n_rows = token[new], row[new], n_rows
        self.size = np.bincount(self.row, minlength=n_rows)

    def hashed(self, salt: int) -> np.ndarray:
        """One number per row that depends on the set only."""
        value = scan.mix(self.token ^ np.uint64(salt * 0x9E3779B9 + 1))
        out = np.zeros(self.n_rows, np.uint64)
        if len(value):
            filled = np.flatnonzero(self.size)
            out[filled] = np.add.reduceat(value, (np.cumsum(self.size) - self.size)[filled])
        return scan.mix(out + self.size.astype(np.uint64))

    def cells(self) -> np.ndarray:
        cell = (self.token >> np.uint64(55)).astype(np.int64)
        counts = np.bincount(self.row * CELLS + cell, minlength=self.n_rows * CELLS).reshape(-1, CELLS)
        return np.minimum(counts, 255).astype(np.uint8)

    def signatures(self, node: np.ndarray, plan: Plan, next_band: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Signatures of all rows under their own band, or under the next one for the rows
        that may link into it; and per row whether its segments are too few to decide."""
        band = np.zeros(self.n_rows, np.int64)
        filled = self.size > 0
        band[filled] = np.frexp(self.size[filled].astype(np.float64))[1] - 1
        if next_band:
            filled = filled & (4 * self.size >= 3 * 2 ** (band + 1))
            band = band + 1
        use = filled[self.row]
        token, row = self.token[use], self.row[use]
        salted = scan.mix(token + np.uint64(plan.salt * 2654435761 + 99991) * (band[row] + 1).astype(np.uint64))
        segment = salted >> plan.shift(band[row])
        order = np.lexsort((segment, row))
        value, row, segment = scan.mix(salted[order] + np.uint64(7)), row[order], segment[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return {k: np.empty(0, t) for k, t in _PARTS}, np.zeros(self.n_rows, bool)
        count = np.diff(np.append(first, len(row)))
        owner = row[first]
        total = np.add.reduceat(value, first)
        place = scan.mix(segment[first] * np.uint64(1024) + band[owner].astype(np.uint64))
        coarse = np.isin(band[owner], list(plan.deletions)) & (count >= 2)
        units = 1 + coarse.astype(np.int64)
        need = self.size // 3 + 1
        before = np.cumsum(units) - units
        start = np.zeros(self.n_rows, np.int64)
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        start[owner[head]] = before[head]
        kept = before - start[owner] < need[owner] + need[owner] // 5 + 4
        have = np.bincount(owner[kept], units[kept], minlength=self.n_rows).astype(np.int64)
        spare = have - need
        member = np.cumsum(new) - 1
        drop = (coarse & kept)[member]
        sig = np.concatenate([scan.mix(total[kept] + place[kept]), scan.mix(total[member][drop] - value[drop] + place[member][drop])])
        whose = np.concatenate([owner[kept], row[drop]])
        out = {
            "sig": sig,
            "node": node[whose],
            "size": self.size[whose].astype(np.int32),
            "band": band[whose].astype(np.int8),
            "units": np.concatenate([units[kept], units[member][drop]]).astype(np.int8),
            "spare": spare[whose].astype(np.int32),
        }
        return out, filled & (spare < 0)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Sets]]:
    ids = batch.column(0)
    data, offsets = scan.utf8(batch.column(1))
    for i, j in scan.blocks(offsets, SET_BYTES):
        yield ids.slice(i, j - i), Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _describe(texts: DataFrame, plan: Plan) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch):
                node, check = sets.hashed(2 * plan.salt), sets.hashed(2 * plan.salt + 1)
                short = sets.signatures(node, plan, False)[1] | sets.signatures(node, plan, True)[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(node.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.array(sets.size.astype(np.int64)),
                        pa.array(short),
                        pa.array([c.tobytes() for c in sets.cells()], pa.binary()),
                    ],
                    names=["doc", "node", "check", "size", "short", "cells"],
                )

    return texts.mapInArrow(emit, INFO)


def _signature_rows(texts: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Signatures packed by bucket: one row per bucket and ``FLUSH`` signatures."""

    def pack(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {k: np.concatenate([x[k] for x in held]) for k, _ in _PARTS}
        bucket = ((whole["sig"] >> np.uint64(8 * SIG_BYTES)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(cut))
        columns = [pa.array(there.astype(np.int32)), *packed({k: v[order] for k, v in whole.items()}, cut, there)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", *[k for k, _ in _PARTS]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, np.empty(0, np.int64)
        for batch in batches:
            for _, sets in _sets(batch):
                node = sets.hashed(2 * plan.salt).view(np.int64)
                # A set that this task has just indexed need not be indexed again.
                _, first = np.unique(node, return_index=True)
                fresh = np.zeros(len(node), bool)
                fresh[first] = True
                fresh &= ~np.isin(node, seen)
                seen = np.concatenate([seen, node[fresh]])
                keep = fresh[sets.row]
                sets.token, sets.row, sets.size = sets.token[keep], sets.row[keep], np.where(fresh, sets.size, 0)
                for next_band in (False, True):
                    found = sets.signatures(node, plan, next_band)[0]
                    held.append(found)
                    count += len(found["sig"])
                if count >= FLUSH:
                    yield pack(held)
                    held, count, seen = [], 0, np.empty(0, np.int64)
        if count:
            yield pack(held)

    return texts.mapInArrow(emit, SIGNATURES)


def _collisions(rows: DataFrame) -> DataFrame:
    """Sets that share a signature, bucket after bucket. Up to ``FEW`` of them: a row per
    pair of ``node`` and ``other``, without ``g``. More: a row per set, with the first set of
    the signature as ``other``."""

    def collide(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        each = [unpacked(x) for x in held]
        parts = {k: np.concatenate([x.pop(k) for x in each]) for k, _ in _PARTS}
        order = np.lexsort((parts["node"], parts["sig"]))
        sig, node = parts["sig"][order], parts["node"][order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        order, sig = order[new], sig[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        of_row = np.repeat(count, count)
        small = (of_row > 1) & (of_row <= FEW)
        size = parts["size"][order].astype(np.int64)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for gap in range(1, FEW):
            i = np.flatnonzero(small[:-gap] & (sig[:-gap] == sig[gap:])) if len(sig) > gap else left[0]
            i = i[4 * np.minimum(size[i], size[i + gap]) >= 3 * np.maximum(size[i], size[i + gap])]
            left.append(i)
            right.append(i + gap)
        many = np.flatnonzero(of_row > FEW)
        one = order[np.concatenate([*left, many])]
        two = order[np.concatenate([*right, np.repeat(first, count)[many]])]
        n_pairs = len(one) - len(many)
        kinds = {"size": np.int32, "band": np.int32, "units": np.int32, "spare": np.int32}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(parts["sig"][one].view(np.int64), mask=np.arange(len(one)) < n_pairs),
                pa.array(parts["node"][one]),
                *[pa.array(parts[k][one].astype(t)) for k, t in kinds.items()],
                pa.array(np.concatenate([np.zeros(n_pairs), of_row[many]]).astype(np.int32)),
                pa.array(parts["node"][two]),
                pa.array(parts["size"][two]),
                pa.array(parts["spare"][two]),
            ],
            names=["g", "node", "size", "band", "units", "spare", "n", "other", "other_size", "other_spare"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
                if number[a] != bucket and held:
                    yield collide(held)
                    held = []
                bucket = number[a]
                held.append(batch.slice(a, b - a))  # a view, not a copy
        if held:
            yield collide(held)

    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(emit, FOUND)


def _similar_sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 4 >= F.greatest(a, b) * 3


def _near(cells_a: np.ndarray, cells_b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets with these histograms and this summed size can be similar enough."""
    return 7 * np.abs(cells_a.astype(np.int16) - cells_b.astype(np.int16)).sum(axis=-1, dtype=np.int64) <= total


def _cell_matrix(column: pa.Array) -> np.ndarray:
    return scan.utf8(column)[0].reshape(-1, CELLS)


def _plausible(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
    return pa.array(_near(_cell_matrix(a), _cell_matrix(b), total.to_numpy(zero_copy_only=False)))


def _compare(rows: DataFrame) -> DataFrame:
    """Plausible pairs ``a, b`` of different components within every piece (g, block): the
    rows that ask against all members of the piece. ``before`` holds the signatures just
    before g in a row's order; two rows that share one have been compared there, so few
    pairs come more than once. The first signature of a pair is never left out."""

    def pairs(held: list[list]) -> pa.RecordBatch:
        g, block, asks, member, node, size, label, cells, *before = (np.concatenate(x) for x in zip(*held, strict=True))
        before = np.stack(before, axis=1)
        cells = np.frombuffer(b"".join(cells.tolist()), np.uint8).reshape(-1, CELLS)
        cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (block[1:] != block[:-1]), [True]]))
        out_a, out_b = [], []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mine = x + np.flatnonzero(member[x:y])
            for q in (x + np.flatnonzero(asks[x:y])).tolist():
                other = mine[(label[mine] != label[q]) & (4 * np.minimum(size[mine], size[q]) >= 3 * np.maximum(size[mine], size[q]))]
                own = before[q][before[q] != 0]
                other = other[~np.isin(before[other], own).any(axis=1)] if len(other) and len(own) else other
                other = other[_near(cells[other], cells[q], size[other] + size[q])] if len(other) else other
                out_a.append(np.minimum(node[other], node[q]))
                out_b.append(np.maximum(node[other], node[q]))
        both = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1) if out_a else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sorted_groups(batches, 1 << 14):
            yield pairs([columns])

    dealt = rows.select("piece", "block", "asks", "member", "node", "size", "label", "cells", *[f"before{i}" for i in range(1, BEFORE + 1)])
    dealt = dealt.repartition(partitions(rows.sparkSession), "piece").sortWithinPartitions("piece", "block")
    return dealt.mapInArrow(emit, "a long, b long")


def _token_sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """``node, tokens, fine`` for the wanted ``doc, node``, each of one document; ``fine`` is a
    histogram of about as many cells as the set has tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch):
                ends = np.concatenate([[0], np.cumsum(sets.size)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.token.view(np.int64)))
                node = sets.hashed(2 * plan.salt).view(np.int64)
                # An id may stand for several texts; only the wanted set counts.
                right = pa.array(node == ids.to_numpy(zero_copy_only=False))
                fine = pa.array([_fine(sets.token[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, tokens, fine], names=["node", "tokens", "fine"]).filter(right)

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = docs.join(F.broadcast(wanted) if few else wanted, "doc").select("node", "text")
    return picked.mapInArrow(emit, "node long, tokens array<long>, fine binary")


def _fine(token: np.ndarray) -> bytes:
    bits = max(6, int(len(token)).bit_length())
    cells = np.bincount((token >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _finely_plausible(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
    """The bound on the fine histograms; the longer one is folded to the shorter. A full
    cell may hold more than it says, and is left out."""
    out = []
    for x, y, n in zip(a, b, total.to_pylist(), strict=True):
        x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int32) for v in (x, y))
        cells = min(len(x), len(y))
        full = [(v.reshape(cells, -1) == 255).any(axis=1) for v in (x, y)]
        x, y = x.reshape(cells, -1).sum(axis=1), y.reshape(cells, -1).sum(axis=1)
        out.append(bool(7 * np.abs(x - y)[~(full[0] | full[1])].sum() <= n))
    return pa.array(out, pa.bool_())


def _verify(pairs: DataFrame, texts: DataFrame, info: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose whole sets are similar enough. Sets travel for those pairs only that
    the fine histograms do not rule out, and not through the driver, however few they are."""
    pairs = stored(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(info.groupBy("node").agg(F.min("doc").alias("doc")).join(nodes, "node", "left_semi"), "wanted")
    sets = stored(_token_sets(texts, wanted, plan), "token-sets")

    def joined(rows: DataFrame, what: str) -> DataFrame:
        for side in ("a", "b"):
            part = sets.select(F.col("node").alias(side), F.col(what).alias(f"_{side}"), F.size("tokens").alias(f"_n{side}"))
            rows = rows.join(part.hint("merge"), side)
        return rows

    plausible = F.arrow_udf(_finely_plausible, "boolean")
    left = joined(pairs, "fine").filter(plausible("_a", "_b", F.col("_na") + F.col("_nb"))).select("a", "b")
    both = joined(stored(left.distinct(), "plausible"), "tokens")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(common * 100 >= (F.col("_na") + F.col("_nb") - common) * 75).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id that can be
    reached over pairs of similar texts.

    Words are lower-cased (A-Z only) and split at white space; a set holds the distinct runs
    of five words, a text of fewer words is one run. Two sets link when their Jaccard
    similarity is at least 0.75. Null, empty and blank texts have no set and stay alone.
    Rows that share an id with different texts count each on its own. Rows without an id
    take no part and have no ``component_id``. Only the two named columns are read.
    Shingles are compared as 64-bit hashes. Ids are integers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    info, plan = _described(spark, texts)
    sets = info.filter("size > 0 and doc is not null").select("doc", "node", "size", "cells")
    cells = sets.groupBy("node").agg(F.any_value("cells").alias("cells"), F.any_value("size").alias("size"))

    found = stored(_collisions(_signature_rows(texts.filter("doc is not null"), plan, 4 * partitions(spark))), "collisions")
    members, shared = found.filter("g is not null"), found.filter("g is null")
    lost = stored(members.groupBy("node", "band").agg(F.sum("units").alias("lost"), F.max("spare").alias("spare")), "lost")
    tight = lost.filter("lost > spare").select("node", "band", (F.col("lost") - F.col("spare")).alias("owed"))

    plausible = F.arrow_udf(_plausible, "boolean")

    def close(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(cells.select(F.col("node").alias(side), F.col("cells").alias(f"_c{side}"), F.col("size").alias(f"_s{side}")), side)
        return pairs.filter(plausible("_ca", "_cb", F.col("_sa") + F.col("_sb"))).select("a", "b")

    counted = shared.groupBy(F.col("node").alias("a"), F.col("other").alias("b"), "band").agg(
        F.count(F.lit(1)).alias("k"), F.max("spare").alias("_pa"), F.max("other_spare").alias("_pb")
    )
    for side in ("a", "b"):
        counted = counted.join(lost.select(F.col("node").alias(side), "band", F.col("lost").alias(f"_l{side}")), [side, "band"], "left")
    spare = F.least(F.col("_pa") - F.coalesce("_la", F.lit(0)), F.col("_pb") - F.coalesce("_lb", F.lit(0)))
    # With one-deletion neighbourhoods a signature may stand for two units: no count there.
    enough = F.col("k") > F.when(F.lit(not plan.deletions), spare).otherwise(0)
    star = members.join(tight, ["node", "band"], "left_semi").filter((F.col("node") != F.col("other")) & _similar_sizes("size", "other_size"))
    first = counted.filter(enough).select("a", "b").union(star.select(F.col("other").alias("a"), F.col("node").alias("b")))
    links = stored(_verify(close(first.distinct()), texts, sets, plan), "links")
    labels = components(links)

    # A linked pair shares more signatures than a set can spare, so a set may leave out as
    # many of its crowded ones as it can spare: the most crowded. The order is the same for
    # all, so the first one that two linked sets share is among those that both of them ask.
    # With one-deletion neighbourhoods the units are no count, and all members stay.
    ordered = Window.partitionBy("node", "band").orderBy("n", "g")
    crowd = ordered.rowsBetween(Window.unboundedPreceding, -1)
    asked_before = F.coalesce(F.sum("units").over(crowd), F.lit(0))
    before = {f"before{i}": F.coalesce(F.lag("g", i).over(ordered), F.lit(0)) for i in range(1, BEFORE + 1)}
    known = members.join(tight, ["node", "band"], "left" if plan.deletions else "inner")
    known = known.withColumns({"asks": F.coalesce(asked_before < F.col("owed"), F.lit(False)), **before})
    known = known if plan.deletions else known.filter("asks")
    known = known.join(labels, "node", "left").select("g", "node", "size", "n", F.coalesce("label", "node").alias("label"), "asks", *before)
    known = stored(known, "many")
    open_ = known.groupBy("g").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("asks").alias("_asks"))
    rows = known.join(open_.filter("_lo != _hi and _asks").select("g"), "g").withColumn("pieces", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    asked = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("block", F.explode(asked)).withColumn("member", F.col("block") == F.col("home"))
    rows = rows.join(cells.select("node", "cells"), "node").withColumn("piece", F.xxhash64("g", "block"))
    more = stored(_verify(_compare(rows).distinct(), texts, sets, plan), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = info.select("doc", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "labelled")
    least = named.filter("size > 0 and doc is not null").groupBy("label").agg(F.min("doc").alias("_least"))
    out = named.join(least, "label", "left")
    return out.select(
        F.col("doc").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when((F.col("size") > 0) & F.col("doc").isNotNull(), F.col("_least")).otherwise(F.col("doc")).alias("component_id"),
    )


def _described(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, Plan]:
    """Size, set number and histogram of every text, under a plan that holds for all of
    them: no two sets share a number, and every set has enough segments."""
    info = None
    for salt in range(8):
        plan = Plan(salt)
        info = stored(_describe(texts, plan), "sets")
        bands = info.filter("size > 0").groupBy(F.floor(F.log2("size")).cast("int").alias("band")).count().collect()
        deletions = choose_deletions({r.band: r["count"] for r in bands})
        if deletions:
            plan = Plan(salt, deletions)
            info = stored(_describe(texts, plan), "sets")
        clash = info.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("short").alias("short"))
        if clash.filter("lo != hi or short").isEmpty():
            return info, plan
    raise RuntimeError("no salt separates the sets")
