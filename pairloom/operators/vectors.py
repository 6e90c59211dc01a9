"""Near copies among given vectors, by random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom import fixed
from pairloom.operators.components import components
from pairloom.operators.lookup import look_up
from pairloom.session import written

# Signs kept per band; the first of them are a bucket's key, the others split full buckets.
CODE_BITS = 30
# Vectors whose codes are made at once: every one gives a row per band and asked bucket.
AT_ONCE = 256


@dataclass(frozen=True)
class Planes:
    """``bands`` independent codes per vector. A vector also asks the buckets that differ in
    one of its ``probes`` least certain signs. ``bucket`` is the size that buckets are to
    have on average, and ``block`` the number of vectors compared with each other at once."""

    bands: int = 10
    probes: int = 3
    bucket: int = 256
    block: int = 2048
    seed: int = fixed.SPLIT_SEED

    def matrix(self, dim: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.seed)).standard_normal((dim, self.bands * CODE_BITS))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows of length 1."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(batches: Iterator[pa.RecordBatch], planes: Planes, bits: int) -> Iterator[pa.RecordBatch]:
    """A row per vector, band and bucket it belongs to or asks: the code, its two least
    certain signs behind the key, and the vector."""
    high = np.int64(1) << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        ids, x = batch.column(0), _matrix(batch.column(1))
        n = len(x)
        margins = (x @ planes.matrix(x.shape[1])).reshape(n, planes.bands, CODE_BITS)
        code = ((margins > 0) * high).sum(axis=2)
        weak_key = np.argsort(np.abs(margins[:, :, :bits]), axis=2)[:, :, : planes.probes]
        rest = np.argsort(np.abs(margins[:, :, bits:]), axis=2)[:, :, :2] + bits
        asked = np.concatenate([code[:, :, None], code[:, :, None] ^ high[weak_key]], axis=2)
        each = asked.shape[2]
        rows = np.repeat(np.arange(n), planes.bands * each)
        columns = [
            ids.take(pa.array(rows)),
            pa.array(np.tile(np.repeat(np.arange(planes.bands, dtype=np.int32), each), n)),
            pa.array(asked.reshape(-1)),
            pa.array(np.tile(np.arange(each) == 0, n * planes.bands)),
            *[pa.array(np.repeat(rest[:, :, j].reshape(-1), each).astype(np.int32)) for j in range(2)],
            batch.column(1).take(pa.array(rows)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "band", "code", "home", "weak0", "weak1", "vector"])


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that can be reached over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class _Bucket:
    """Vectors of one bucket as they come, joined into groups of linked ones.

    Up to ``block`` vectors are compared with each other. Of a bucket that is larger, each
    further block is also compared with a vector per group that was found before.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.ids, self.x = np.empty(0, np.int64), None

    def add(self, ids: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """Links that join these vectors' groups: one less than vectors per group."""
        n, old = len(ids), len(self.ids)
        a, b = np.nonzero(np.triu(x @ x.T >= self.threshold, 1))
        pairs = [(a + old, b + old)]
        # Vectors of different groups are not near to each other: only new ones meet the old,
        # as many at once as there are new ones.
        for at in range(0, old, n):
            a, b = np.nonzero(self.x[at : at + n] @ x.T >= self.threshold)
            pairs.append((a + at, b + old))
        if old:
            ids, x = np.concatenate([self.ids, ids]), np.concatenate([self.x, x])
        label = _joined(len(ids), *(np.concatenate(p) for p in zip(*pairs, strict=True)))
        moved = np.flatnonzero((label != np.arange(len(ids))) & (ids != ids[label]))
        links = list(zip(ids[label[moved]].tolist(), ids[moved].tolist(), strict=True))
        roots = np.unique(label)
        self.ids, self.x = ids[roots], x[roots]
        return links


def _links(batches: Iterator[pa.RecordBatch], threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket. Memory holds a block, and a vector per group of the bucket."""
    now, bucket, held = None, None, []

    def settle() -> list[tuple[int, int]]:
        nonlocal held
        ids = np.concatenate([h[0] for h in held])
        x = np.concatenate([h[1] for h in held])
        first = np.unique(ids, return_index=True)[1]
        held = []
        return bucket.add(ids[first], x[first])

    for batch in batches:
        if not batch.num_rows:
            continue
        band, key, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        x = _matrix(batch.column(3))
        cut = np.flatnonzero((np.diff(band) != 0) | (np.diff(key) != 0)) + 1
        links = []
        for lo, hi in zip([0, *cut], [*cut, len(ids)], strict=True):
            if (band[lo], key[lo]) != now:
                if held:
                    links += settle()
                now, bucket = (band[lo], key[lo]), _Bucket(threshold)
            for at in range(lo, hi, block):
                held.append((ids[at : min(at + block, hi)], x[at : min(at + block, hi)]))
                if sum(len(h[0]) for h in held) >= block:
                    links += settle()
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    if held:
        links = settle()
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_vectors(df: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", planes: Planes = Planes()) -> DataFrame:
    """``vec_id, group_id, n_copies``: vectors whose cosine is at least ``threshold`` are in one
    group, and so are those that a chain of such links joins. ``group_id`` is the least id of
    the group, ``n_copies`` the number of rows with exactly this vector.

    Vectors have one length and ids are whole numbers. A missing vector, one with a missing
    or infinite value, or of length 0 has no direction and no link. Exact copies are one
    vector until the end. Every vector stands in a bucket per band and asks its neighbours; every
    pair that meets is checked by its cosine. Which pairs meet is random with a fixed seed:
    tests measure the share against all pairs. Buckets above ``planes.block`` are split by
    further signs, then taken block by block; a bucket gives fewer links than it has rows.
    """
    spark = df.sparkSession
    value = F.col(vector).cast("array<float>")
    usable = F.coalesce(F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(usable, value).alias("vector"))
    rows = rows.withColumn("hash", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(planes.seed), "vector"))))
    known = rows.filter(F.col("hash").isNotNull())
    one = written(known.groupBy("hash").agg(F.min("vec_id").alias("id"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n_copies")), "vectors")
    n = one.count()
    bits = min(max(math.ceil(math.log2(max(n, 1) / planes.bucket)), 1), CODE_BITS - 4)
    kind = "id bigint, band int, code bigint, home boolean, weak0 int, weak1 int, vector array<float>"
    coded = written(one.select("id", "vector").mapInArrow(lambda b: _codes(b, planes, bits), kind), "codes")
    key = F.shiftright("code", CODE_BITS - bits)
    coded = coded.withColumn("bucket", F.col("band").cast("bigint") * (1 << bits) + key)
    sizes = coded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    full = sizes.filter(F.col("_n") > planes.block).select("bucket", F.col("_n").alias("_size"), "_n")
    sized = look_up(coded, full, "bucket", "_n")
    more = F.least(F.ceil(F.log2(F.col("_size") / planes.block)), F.lit(CODE_BITS - bits)).cast("int")
    more = F.when(F.col("_size").isNotNull(), more).otherwise(0)
    sign = lambda c: F.expr(f"shiftleft(1L, {CODE_BITS - 1} - {c})")
    inside = lambda c: F.col(c) < F.lit(bits) + more
    spread = F.array_compact(
        F.array("code", *[F.when(inside(c), F.col("code").bitwiseXOR(sign(c))) for c in ("weak0", "weak1")])
    )
    placed = sized.select("band", more.alias("_more"), F.explode(spread).alias("code"), "id", "vector")
    bucket = F.expr(f"shiftright(code, {CODE_BITS - bits} - _more)") * 64 + F.col("_more")
    placed = placed.select("band", bucket.alias("bucket"), "id", "vector")
    met = placed.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "id")
    links = met.mapInArrow(lambda b: _links(b, threshold, planes.block), "a bigint, b bigint")
    groups = components(links)
    least = one.join(groups.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    named = least.select("hash", F.coalesce("component_id", "id").alias("group_id"), F.col("n_copies"), F.col("n_copies").alias("_n"))
    found = look_up(known.select("vec_id", "hash"), named, "hash", "_n")
    return found.select("vec_id", "group_id", "n_copies").unionByName(
        rows.filter(F.col("hash").isNull()).select("vec_id", F.col("vec_id").alias("group_id"), F.lit(1).cast("bigint").alias("n_copies"))
    )
