"""Parameters of the operators. Defaults come from ``fixed``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pairloom import fixed


@dataclass(frozen=True)
class GateConfig:
    min_len: int = fixed.MIN_LENGTH
    max_len: int = fixed.MAX_LENGTH
    min_diff: float = fixed.MIN_QUALITY_DIFFERENCE
    blacklist: tuple[str, ...] = fixed.BLACKLIST


@dataclass(frozen=True)
class ScoreConfig:
    gate: GateConfig = field(default_factory=GateConfig)
    categories: tuple[tuple[str, ...], ...] = tuple(fixed.CATEGORIES.values())
    weights: tuple[float, float, float, float] = fixed.SCORE_WEIGHTS
    good_length: tuple[int, int] = (50, 1000)
    ideal_length: tuple[int, int] = (100, 500)

    @property
    def seam(self) -> int:
        """Characters on each side of the joint of two texts in which a keyword
        with a space can match across the joint."""
        return max((len(w) for words in self.categories for w in words if " " in w), default=1) - 1


@dataclass(frozen=True)
class AnswerConfig:
    terms: tuple[str, ...] = fixed.TECHNICAL_TERMS
    indicators: tuple[str, ...] = fixed.QUALITY_INDICATORS
    weak_below: float = fixed.WEAK_DIFFERENCE


@dataclass(frozen=True)
class ChatMarkers:
    start: str = fixed.TURN_START
    end: str = fixed.TURN_END
