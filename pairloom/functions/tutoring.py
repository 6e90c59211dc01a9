"""Level, outcome and error expressions of the tutor."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from pairloom import fixed
from pairloom.functions.text import ColumnOrName, col, or_empty


def level_to_difficulty(
    level: ColumnOrName, table: Mapping[str, str] = fixed.LEVEL_DIFFICULTY, default: str = "beginner"
) -> Column:
    known = F.coalesce(col(level), F.lit(default))
    out = F.lit("medium")
    for name, difficulty in table.items():
        out = F.when(known == name, difficulty).otherwise(out)
    return out


def assessment_outcome(text: ColumnOrName) -> Column:
    """``mastered``, ``weak`` or null; the marks are case-sensitive."""
    return F.when(F.contains(col(text), F.lit(fixed.MASTERED_MARK)), "mastered").when(
        F.contains(col(text), F.lit(fixed.WEAK_MARK)), "weak"
    )


def error_answer(agent: ColumnOrName, message: ColumnOrName) -> Column:
    return F.concat(F.lit("Error in "), or_empty(agent), F.lit(": "), or_empty(message))
