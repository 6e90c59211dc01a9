"""The formulas, restated row by row in Python."""

from __future__ import annotations

from pairloom import fixed
from pairloom.config import AnswerConfig, ScoreConfig


def _n_sentences(text):
    return sum(1 for piece in text.split(".") if piece.strip())


def answer_score(text, cfg=AnswerConfig()):
    low, n, k = text.lower(), len(text), _n_sentences(text)
    length = 0.1 if n < 50 else 0.3 if n < 100 else 0.6 if n < 200 else 0.9
    structure = 0.9 if k >= 4 else 0.6 if k >= 2 else 0.2
    depth = min(sum(t in low for t in cfg.terms) / 5, 1.0)
    teaching = min(sum(t in low for t in cfg.indicators) / 4, 1.0)
    return min(length * 0.25 + structure * 0.25 + depth * 0.3 + teaching * 0.2, 1.0)


def _text(row, *names):
    return "".join(row.get(n) or "" for n in names)


def _passes(text, row, required, gate):
    return (
        all((row.get(n) or "").strip() for n in required)
        and gate.min_len <= len(text) <= gate.max_len
        and not any(w in text.lower() for w in gate.blacklist)
    )


def scores(sft, pref, cfg=ScoreConfig()):
    s, p = _text(sft, "instruction", "input", "output"), _text(pref, "prompt", "chosen", "rejected")
    sft_ok = _passes(s, sft, ("instruction", "output"), cfg.gate)
    pref_ok = _passes(p, pref, ("prompt", "chosen", "rejected"), cfg.gate)
    pref_ok = pref_ok and (pref.get("quality_difference") or 0) >= cfg.gate.min_diff

    quality = 0.0
    if sft_ok and pref_ok:
        quality = 0.6 + (0.2 if 50 <= len(s) <= 1000 else 0.0) + (0.2 if 50 <= len(p) <= 1000 else 0.0)

    both = (s + " " + p).lower()
    hits = sum(any(w in both for w in words) for words in cfg.categories)
    relevance = (0.0, 0.2, 0.4, 0.6)[min(hits, 3)]
    if sft.get("topic") and sft.get("topic") == pref.get("topic"):
        relevance += 0.4

    k, words = _n_sentences(s), s.split()
    diversity = (0.4 if 100 <= len(s) <= 500 else 0.2) + (0.3 if k >= 3 else 0.2 if k >= 2 else 0.1)
    diversity += len(set(words)) / len(words) * 0.3 if words else 0
    level = sft.get("difficulty") or "medium"
    difficulty = fixed.DIFFICULTY_SCORES.get(level, fixed.OTHER_DIFFICULTY_SCORE)

    quality, relevance = min(quality, 1.0), min(relevance, 1.0)
    a, b, c, d = cfg.weights
    total = quality * a + relevance * b + diversity * c + difficulty * d
    return sft_ok, pref_ok, quality, relevance, diversity, difficulty, total
