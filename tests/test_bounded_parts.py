"""Vectors in parts of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pairloom.operators.vectors import Planes, _Bucket, _codes


def test_a_batch_of_vectors_is_coded_in_small_parts():
    x = np.random.Generator(np.random.PCG64(1)).standard_normal((3000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "vector"])
    planes = Planes(bands=2, probes=1)
    parts = list(_codes(iter([batch]), planes, 4))
    assert sum(p.num_rows for p in parts) == 3000 * 2 * 2
    assert max(p.num_rows for p in parts) <= 256 * 2 * 2  # was the whole batch


def test_a_bucket_joins_over_blocks_what_all_pairs_join():
    r = np.random.Generator(np.random.PCG64(2))
    x = r.standard_normal((40, 6))[r.integers(0, 40, 600)] + r.standard_normal((600, 6)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bucket, near = _Bucket(0.95), x @ x.T >= 0.95
    links = [pair for at in range(0, 600, 100) for pair in bucket.add(np.arange(at, at + 100), x[at : at + 100])]
    assert len(links) <= 600 - len(bucket.ids)
    assert all(a < b for a, b in links)
    first = _Bucket(0.95)
    whole = first.add(np.arange(600), x)
    reach = np.eye(600, dtype=bool) | near
    while (more := reach @ reach).sum() > reach.sum():
        reach = more
    want = reach.argmax(axis=1)
    got = np.arange(600)
    for a, b in sorted(whole, key=lambda p: p[1]):
        got[b] = got[a]
    assert (got == want).all()
