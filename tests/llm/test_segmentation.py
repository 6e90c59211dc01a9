"""How much of a text the search for its segmentations looks at, and that the rest changes nothing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pairloom.llm import scan, segmentation
from pairloom.llm.queries import MODEL, SAMPLES
from pairloom.llm.segmentation import Vocabulary, sample_block

ODD = ["", "a", "the", " ", "  x  ", "\u2581", "\x00\x01", "\u6f22\u5b57" * 40, "aaaa" * 300, "\u00e4 \u2603 \U0001f600 end", "1 " * 500]


def _texts(n, words, seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("etaoins") for _ in range(r.randint(1, 9))) for _ in range(words)) for _ in range(n)]


def test_sets_far_down_a_text_are_not_drawn(monkeypatch):
    vocabulary, hashed, mix = Vocabulary(MODEL), [], scan.mix
    text, seeds = _texts(1, 20_000, 1)[0], mix(np.arange(1, 2, dtype=np.uint64))
    monkeypatch.setattr(scan, "mix", lambda x: hashed.append(len(x)) or mix(x))
    (samples,) = sample_block([text], seeds, SAMPLES, vocabulary).to_pylist()
    steps = [len(s["ids"]) for s in samples]
    # A number for each character, which names the words, and one for each step that is drawn.
    assert sum(hashed) < len(text) + 1 + sum(steps) + max(steps) // 4


@pytest.mark.parametrize("k", [1, 2, 5])
def test_what_is_left_out_changes_nothing(monkeypatch, k):
    vocabulary = Vocabulary(MODEL)
    texts = [*ODD, None, *_texts(12, 600, 2), *_texts(40, 3, 3)] * 2
    seeds = scan.mix(np.arange(len(texts), dtype=np.uint64))
    got = []
    # All sets; as given; and a limit so high that almost every text is looked at again.
    for far_off, too_low in ((-np.inf, -np.inf), (segmentation.FAR_OFF, segmentation.TOO_LOW), (-36.0, 0.7)):
        monkeypatch.setattr(segmentation, "FAR_OFF", far_off)
        monkeypatch.setattr(segmentation, "TOO_LOW", too_low)
        got.append(sample_block(texts, seeds, k, vocabulary).to_pylist())
    assert got[0] == got[1] == got[2]
