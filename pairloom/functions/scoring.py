"""Quality gates and scores as built-in expressions, but for long vocabularies (``_one_pass``)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from pairloom import fixed
from pairloom.config import AnswerConfig, GateConfig, ScoreConfig
from pairloom.functions.text import (
    ColumnOrName,
    col,
    contains_any,
    count_contains,
    let,
    not_blank,
    or_empty,
    sentence_count_to,
    words,
)


def step(index: Column, *values: float) -> Column:
    """Value by a count that runs to the table's end; the count is evaluated once."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), index)


def sft_text(at: str = "") -> Column:
    return F.concat(*[or_empty(at + c) for c in ("instruction", "input", "output")])


def preference_text(at: str = "") -> Column:
    return F.concat(*[or_empty(at + c) for c in ("prompt", "chosen", "rejected")])


def spaced(*cs: ColumnOrName) -> Column:
    """Fields joined by single blanks, as the length profile measures them."""
    parts = [p for c in cs for p in (F.lit(" "), or_empty(c))]
    return F.concat(*parts[1:])


def text_gate(
    text: ColumnOrName, cfg: GateConfig, lowered: ColumnOrName | None = None, length: ColumnOrName | None = None
) -> Column:
    """Length in bounds and no blacklisted substring; ``lowered`` and ``length`` where they
    exist already."""

    def gate(t: Column) -> Column:
        n = F.length(t) if length is None else col(length)
        low = F.lower(t) if lowered is None else lowered
        return n.between(cfg.min_len, cfg.max_len) & ~contains_any(low, cfg.blacklist)

    return let(text, gate)


def sft_gate(
    cfg: GateConfig = GateConfig(), at: str = "", text: ColumnOrName | None = None, **known: ColumnOrName
) -> Column:
    text = sft_text(at) if text is None else text
    return not_blank(at + "instruction", at + "output") & text_gate(text, cfg, **known)


def preference_gate(
    cfg: GateConfig = GateConfig(), at: str = "", text: ColumnOrName | None = None, **known: ColumnOrName
) -> Column:
    text = preference_text(at) if text is None else text
    gap = F.coalesce(F.col(at + "quality_difference").cast("double"), F.lit(0.0)) >= cfg.min_diff
    return gap & not_blank(at + "prompt", at + "chosen", at + "rejected") & text_gate(text, cfg, **known)


def basic_quality(
    both_ok: Column, sft_length: Column, preference_length: Column, cfg: ScoreConfig = ScoreConfig()
) -> Column:
    lo, hi = cfg.good_length
    bonus = [F.when(n.between(lo, hi), 0.2).otherwise(0.0) for n in (sft_length, preference_length)]
    return F.when(both_ok, F.least(F.lit(0.6) + bonus[0] + bonus[1], F.lit(1.0))).otherwise(0.0)


# More categories than this do not raise the relevance.
ENOUGH_CATEGORIES = 3
# From so many keywords on, a text is searched once for each category.
MANY_KEYWORDS = 32


def _one_pass(filled: list[tuple[int, list[str]]]):
    """Bits of the categories that a text has. A category's keywords are one pattern without
    backtracking, while a search of its own for each keyword reads the text as often."""
    patterns = [(bit, "|".join(re.escape(t) for t in terms)) for bit, terms in filled]

    def search(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int32)
        left, rest = np.arange(len(texts)), texts.cast(pa.binary())
        for bit, pattern in patterns:
            hit = pc.match_substring_regex(rest, pattern).fill_null(False).to_numpy(zero_copy_only=False)
            bits[left[hit]] |= bit
            on = np.bitwise_count(bits[left]) < ENOUGH_CATEGORIES
            if not on.all():
                left, rest = left[on], rest.filter(pa.array(on))
        return pa.array(bits)

    return F.arrow_udf(search, "int").asNondeterministic()


def category_bits(lowered: ColumnOrName, categories: Sequence[Sequence[str]]) -> Column:
    """Bit i is set where the text holds a keyword of category i. Once enough categories
    are found the text is not searched further, so later bits may stay unset."""
    filled = [(1 << i, list(terms)) for i, terms in enumerate(categories) if terms]
    if not filled:
        return F.lit(0)
    if sum(len(terms) for _, terms in filled) >= MANY_KEYWORDS:
        return _one_pass(filled)(col(lowered))
    listed = F.array(
        *[F.struct(F.lit(bit).alias("bit"), F.array(*[F.lit(t) for t in terms]).alias("terms")) for bit, terms in filled]
    )

    def found(text: Column) -> Column:
        def add_category(bits: Column, category: Column) -> Column:
            hit = F.exists(category["terms"], lambda t: F.contains(text, t))
            return F.when(F.bit_count(bits) >= ENOUGH_CATEGORIES, bits).when(hit, bits.bitwiseOR(category["bit"])).otherwise(bits)

        return F.aggregate(listed, F.lit(0), add_category)

    return let(lowered, found)


def domain_relevance(bits: Column, first_topic: Column, second_topic: Column) -> Column:
    covered = step(F.least(F.bit_count(bits), F.lit(ENOUGH_CATEGORIES)), 0.0, 0.2, 0.4, 0.6)
    same = (or_empty(first_topic) != "") & first_topic.eqNullSafe(second_topic)
    return F.least(covered + F.when(same, 0.4).otherwise(0.0), F.lit(1.0))


def diversity(
    text: ColumnOrName, cfg: ScoreConfig = ScoreConfig(), length: ColumnOrName | None = None
) -> Column:
    n = F.length(col(text)) if length is None else col(length)
    band = F.when(n.between(*cfg.ideal_length), 0.4).otherwise(0.2)
    richness = step(sentence_count_to(text, 3), 0.1, 0.1, 0.2, 0.3)
    split = words(text)
    ratio = F.try_divide(F.size(F.array_distinct(split)), F.size(split))
    return band + richness + F.coalesce(ratio * 0.3, F.lit(0.0))


def difficulty_balance(difficulty: ColumnOrName) -> Column:
    level = F.coalesce(col(difficulty), F.lit("medium"))
    score = F.when(level == "easy", fixed.DIFFICULTY_SCORES["easy"])
    score = score.when(level == "medium", fixed.DIFFICULTY_SCORES["medium"])
    return score.otherwise(fixed.OTHER_DIFFICULTY_SCORE)


def total_score(
    quality: Column, relevance: Column, diversity_: Column, difficulty: Column, cfg: ScoreConfig = ScoreConfig()
) -> Column:
    a, b, c, d = cfg.weights
    return quality * a + relevance * b + diversity_ * c + difficulty * d


def answer_score(text: ColumnOrName, cfg: AnswerConfig = AnswerConfig()) -> Column:
    text = or_empty(text)
    n = F.length(text)
    size = step(sum([(n >= edge).cast("int") for edge in (50, 100, 200)], F.lit(0)), 0.1, 0.3, 0.6, 0.9)
    structure = step(sentence_count_to(text, 4), 0.2, 0.2, 0.6, 0.6, 0.9)
    found = let(
        F.lower(text),
        lambda low: F.struct(
            count_contains(low, cfg.terms).alias("terms"), count_contains(low, cfg.indicators).alias("indicators")
        ),
    )
    depth = F.least(found["terms"] / F.lit(5.0), F.lit(1.0))
    teaching = F.least(found["indicators"] / F.lit(4.0), F.lit(1.0))
    return F.least(size * 0.25 + structure * 0.25 + depth * 0.3 + teaching * 0.2, F.lit(1.0))


def clamped_gap(better: ColumnOrName, worse: ColumnOrName) -> Column:
    return F.greatest(col(better) - col(worse), F.lit(0.0))


def quality_difference(
    chosen: ColumnOrName, rejected: ColumnOrName, cfg: AnswerConfig = AnswerConfig()
) -> Column:
    return clamped_gap(answer_score(chosen, cfg), answer_score(rejected, cfg))
