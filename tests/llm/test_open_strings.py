"""Strings around one anchor are indexed only where they may share a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import run_length_index as rli, scan

WINDOW, SEED, ANCHOR = 20, 6, b"ANCHOR"


def _around(r: np.random.Generator, n: int) -> list[bytes]:
    """Some sides of the anchor, most of them copies with a few bytes changed or cut."""
    out: list[bytes] = []
    for _ in range(n):
        sides = out[r.integers(len(out))].split(ANCHOR) if out and r.random() < 0.7 else [bytes(r.integers(97, 100, WINDOW - SEED).tolist()) for _ in "lr"]
        left, right = (bytearray(x) for x in sides)
        for side in (left, right):
            if side and r.random() < 0.6:
                side[r.integers(len(side))] = 120
        s = bytes(left[r.integers(4) :]) + ANCHOR + bytes(right[: len(right) - r.integers(4)])
        out.append(s if len(s) >= WINDOW else bytes(left) + ANCHOR + bytes(right))
    return [s for s in out if len(s) >= WINDOW]


def _columns(groups: list[list[bytes]]):
    strings = [s for g in groups for s in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    n = np.array([len(s) - WINDOW + 1 for s in strings])
    h = np.full(len(strings), scan.Sums(np.frombuffer(ANCHOR, np.uint8)).every(SEED)[0].astype(np.int64))
    return group, strings, n, h


@pytest.mark.parametrize("seed", range(20))
def test_no_repeated_window_is_lost(seed):
    group, strings, n, h = _columns([_around(np.random.default_rng(seed), 25)])
    whole = rli.later_windows(group, strings, n, WINDOW)
    may = rli.may_share(h, strings, WINDOW, SEED)
    kept = rli.later_windows(group[may], [s for s, m in zip(strings, may, strict=True) if m], n[may], WINDOW)
    assert whole.any() and kept.tolist() == whole[np.repeat(may, n)].tolist() and kept.sum() == whole.sum()


def test_strings_that_share_the_anchor_only_are_not_indexed(monkeypatch):
    indexed = []

    class Counted(rli.RunLengthIndex):
        def __init__(self, symbols, ends):
            indexed.append(len(symbols))
            super().__init__(symbols, ends)

    monkeypatch.setattr(rli, "RunLengthIndex", Counted)
    side = lambda c: c * (WINDOW - SEED)
    alone = [side(a) + ANCHOR + side(b) for a, b in ((b"a", b"b"), (b"c", b"d"), (b"e", b"f"))]
    twice = [b"x" * 9 + ANCHOR + b"y" * 5 + side(b"z"), b"x" * 9 + ANCHOR + b"y" * 5 + side(b"w")]
    _, strings, n, h = _columns([alone + twice])
    rows = [h, np.arange(5), np.zeros(5, np.int32), n.astype(np.int32)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(strings, pa.binary())], names=["h", "doc", "pos", "n", "s"])
    spans = [x for b in rli._query_indexes(iter([batch]), WINDOW, SEED) for x in b.to_pylist()]
    assert spans == [{"doc": 4, "pos": 0, "n": 1}]
    assert sum(indexed) == len(twice[0])
