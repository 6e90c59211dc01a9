"""The greedy choice looks up a row's features together."""

from __future__ import annotations

import numpy as np

from pairloom.operators import diversity


class _Whole(np.ndarray):
    def tolist(self):
        raise AssertionError("features are looked up together, not one by one")


def test_greedy_looks_features_up_together():
    r = np.random.default_rng(4)
    features = [r.integers(-40, 40, r.integers(0, 12)) for _ in range(60)]
    bonus = r.random(60).round(1).tolist()
    covered, left, expected = set(), set(range(60)), []
    while len(expected) < 25:
        gain = {p: sum(x not in covered for x in features[p].tolist()) + bonus[p] for p in left}
        best = min(left, key=lambda p: (-gain[p], p))
        expected.append((best, gain[best]))
        covered |= set(features[best].tolist())
        left.remove(best)
    assert diversity.greedy(list(range(60)), [f.view(_Whole) for f in features], bonus, 25) == expected
    assert diversity.greedy([], [], [], 3) == []
