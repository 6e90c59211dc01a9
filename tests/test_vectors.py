"""Near copies among vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from pairloom.operators.components import components
from pairloom.operators.vectors import CODE_BITS, Planes, _links, near_vectors

SCHEMA = "vec_id long, embedding array<float>, group_id string, id int"


def _groups(ids, x, threshold):
    """Least id of each component over all pairs, and the number of links."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.array(ids)
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return dict(zip(ids, label.tolist(), strict=True)), near
        label = low


def _vectors(seed=3, dim=32):
    """Groups of near copies of all sizes, one of them large, among unrelated vectors."""
    r = np.random.default_rng(seed)
    x = [r.normal(size=dim) for _ in range(600)]
    for size in (2, 3, 10, 40):
        for _ in range(6):
            centre = r.normal(size=dim)
            x += [centre + r.normal(size=dim) * 0.18 for _ in range(size)]
    centre = r.normal(size=dim)
    x += [centre + r.normal(size=dim) * 0.12 for _ in range(500)]
    return np.array(x, dtype=np.float32)


def _run(spark, ids, x, **kwargs):
    df = spark.createDataFrame([(int(i), v.tolist() if v is not None else None, "g", 1) for i, v in zip(ids, x, strict=True)], SCHEMA)
    return {r.vec_id: (r.group_id, r.n_copies) for r in near_vectors(df.repartition(4), **kwargs).collect()}


@pytest.mark.parametrize("planes", [Planes(), Planes(bucket=8, block=64)])
def test_recall_against_all_pairs(spark, planes):
    x = _vectors()
    order = np.random.default_rng(1).permutation(len(x))
    ids = [int(i) * 3 - 50 for i in order]
    want, near = _groups(ids, x.astype(float), 0.9)
    got = {i: g for i, (g, _) in _run(spark, ids, x, planes=planes).items()}
    assert set(got) == set(want)
    # No two vectors are together that no chain of links joins.
    assert all(want[g] == want[i] for i, g in got.items())
    links = [(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b]
    found = sum(got[a] == got[b] for a, b in links) / len(links)
    assert len(links) > 50_000 and found >= (0.999 if planes == Planes() else 0.95)
    # Pairs count as much as large groups do: of the groups of two and three, each link.
    small = [(a, b) for a, b in links if list(want.values()).count(want[a]) <= 3]
    assert len(small) > 15 and sum(got[a] == got[b] for a, b in small) / len(small) >= (0.999 if planes == Planes() else 0.9)


def test_odd_vectors(spark):
    v = np.array([1, 2, 3], dtype=np.float32)
    x = [v, v, v * 2, None, np.zeros(3, np.float32), np.array([np.nan, 1, 1], np.float32), np.array([np.inf, 1, 1], np.float32), -v, v + np.float32(0.01)]
    got = _run(spark, range(9), x)
    assert {i: g for i, (g, _) in got.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 0}
    assert [got[i][1] for i in (0, 1, 2, 3)] == [2, 2, 1, 1]
    assert _run(spark, [], []) == {}
    assert _run(spark, [5], [v]) == {5: (5, 1)}


def test_a_bucket_gives_fewer_links_than_rows():
    """However many of its pairs are near."""
    import pyarrow as pa

    r = np.random.default_rng(0)
    x = (r.normal(size=16) + r.normal(size=(3000, 16)) * 0.01).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32) * 16), pa.array(x.reshape(-1)))
    columns = [pa.array(np.zeros(3000, np.int32)), pa.array(np.full(3000, 7)), pa.array(np.arange(3000)), vectors]
    whole = pa.RecordBatch.from_arrays(columns, names=["band", "bucket", "id", "vector"])
    links = [row for b in _links(iter([whole.slice(0, 1700), whole.slice(1700)]), 0.9, 256) for row in zip(*b.to_pydict().values(), strict=True)]
    assert len(links) == 2999 and {a for a, _ in links} == {0}
    assert CODE_BITS < 62


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(500)] + [(int(a), int(b)) for a, b in r.integers(2000, 2600, (250, 2))]
    pairs += [(-3, -3), (-5, -4)]
    label = {i: i for p in pairs for i in p}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {x.id: x.component_id for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    del label[-3]
    # An id whose only link is to itself has none.
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: c for i, c in label.items() if i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
