"""Signatures travel as few bytes and lose nothing by it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pairloom.llm import jaccard_join as jj


def _signatures(n: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(5)
    size = r.integers(1, 5000, n).astype(np.int32)
    usual = (size // 3 + 1) // 5 + 4
    return {
        "sig": r.integers(0, 2**63, n, dtype=np.uint64),
        "node": r.integers(-(2**63), 2**63, n),
        "size": size,
        "band": (np.log2(size).astype(int) + r.integers(0, 2, n)).astype(np.int8),
        "units": r.integers(1, 3, n).astype(np.int8),
        "spare": (usual - r.integers(-1, 300, n)).astype(np.int32),
    }


def test_packed_signatures_come_back():
    parts, cut = _signatures(1000), np.array([0, 300, 300, 1000])
    columns = jj.packed(parts, cut, np.array([0, 2]))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 2], pa.int32()), *columns], names=["bucket", *[k for k, _ in jj._PARTS]])
    low = np.uint64(2 ** (8 * jj.SIG_BYTES) - 1)
    for row, span in ((0, slice(0, 300)), (1, slice(300, 1000))):
        got = jj.unpacked(batch.slice(row, 1))
        for name, values in parts.items():
            expected = values[span] if name != "sig" else (values[span] & low) | np.uint64(batch.column(0)[row].as_py() << (8 * jj.SIG_BYTES))
            assert got[name].tolist() == expected.tolist(), name
    # A signature took 26 bytes before.
    assert sum(len(x) for c in columns for x in c.to_pylist()) == 23 * 1000
