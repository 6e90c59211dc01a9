"""Texts sent to a model or used for training, as concat expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from pairloom import fixed, wording
from pairloom.config import ChatMarkers
from pairloom.functions.text import ColumnOrName, col, not_blank, or_empty, render


def prompt_text(instruction: ColumnOrName, input_: ColumnOrName) -> Column:
    """Instruction, and the input on a new line unless it is blank."""
    tail = F.when(not_blank(input_), F.concat(F.lit("\n"), col(input_))).otherwise("")
    return F.concat(or_empty(instruction), tail)


def eval_prompt(prompt: ColumnOrName, input_: ColumnOrName) -> Column:
    """Like :func:`prompt_text`, but any non-empty input counts, blank or not."""
    tail = F.when(or_empty(input_) != "", F.concat(F.lit("\n"), col(input_))).otherwise("")
    return F.concat(or_empty(prompt), tail)


def chat_prompt(user: ColumnOrName, m: ChatMarkers = ChatMarkers()) -> Column:
    """One user turn and an open assistant turn."""
    return F.concat(F.lit(f"{m.start}user\n"), or_empty(user), F.lit(f"{m.end}\n{m.start}assistant\n"))


def chat_turns(user: ColumnOrName, answer: ColumnOrName, m: ChatMarkers = ChatMarkers()) -> Column:
    return F.concat(chat_prompt(user, m), or_empty(answer), F.lit(m.end))


def answer_system(
    topic: ColumnOrName,
    concept: ColumnOrName,
    difficulty: ColumnOrName,
    template: str = wording.ANSWER_SYSTEM,
    styles: Mapping[str, str] = wording.STYLES,
) -> Column:
    style = F.lit(None).cast("string")
    for level, text in styles.items():
        style = F.when(col(difficulty) == level, text).otherwise(style)
    return render(template, topic=topic, concept=concept, level=F.upper(col(difficulty)), style=style)


def answer_user(
    instruction: ColumnOrName,
    input_: ColumnOrName,
    template: str = wording.ANSWER_USER,
    with_input: str = wording.ANSWER_USER_WITH_INPUT,
) -> Column:
    full = render(with_input, instruction=instruction, input=input_)
    return F.when(not_blank(input_), full).otherwise(render(template, instruction=instruction))


def fallback_answer(
    instruction: ColumnOrName, concept: ColumnOrName, topic: ColumnOrName, difficulty: ColumnOrName
) -> Column:
    """Answer by class of request, used where the model gave none."""
    low = F.lower(or_empty(instruction))
    slots = {"concept": concept, "topic": topic}
    by_level = (
        F.when(col(difficulty) == "easy", render(fixed.FALLBACK_EASY, **slots))
        .when(col(difficulty) == "medium", render(fixed.FALLBACK_MEDIUM, **slots))
        .otherwise(render(fixed.FALLBACK_HARD, **slots))
    )

    def asks(a: str, b: str) -> Column:
        return F.contains(low, F.lit(a)) | F.contains(low, F.lit(b))

    body = (
        F.when(asks("explain", "what is"), F.concat(render(fixed.FALLBACK_EXPLAIN, **slots), by_level))
        .when(asks("compare", "difference"), render(fixed.FALLBACK_COMPARE, **slots))
        .when(asks("example", "application"), render(fixed.FALLBACK_EXAMPLE, **slots))
        .when(asks("learn", "study"), render(fixed.FALLBACK_LEARN, **slots))
        .otherwise("")
    )
    return F.concat(render(fixed.FALLBACK_BASE, difficulty=difficulty, **slots), body)


def fallback_response(prompt: ColumnOrName) -> Column:
    return render(fixed.FALLBACK_RESPONSE, prompt=prompt)


def degradation_system(strategy: ColumnOrName, template: str = wording.DEGRADE_SYSTEM) -> Column:
    """Empty for a strategy that has no wording of its own."""
    known = col(strategy).isin(*wording.DEGRADE_USER)
    return F.when(known, render(template, strategy=strategy)).otherwise("")


def degradation_prompt(
    prompt: ColumnOrName,
    topic: ColumnOrName,
    strategy: ColumnOrName,
    templates: Mapping[str, str] = wording.DEGRADE_USER,
    default: str = "oversimplify",
) -> Column:
    text = render(templates[default], prompt=prompt, topic=topic)
    for name, template in templates.items():
        if name != default:
            text = F.when(col(strategy) == name, render(template, prompt=prompt, topic=topic)).otherwise(text)
    return text


def judge_prompt(
    prompt: ColumnOrName, first: ColumnOrName, second: ColumnOrName, template: str = wording.JUDGE
) -> Column:
    return render(template, prompt=prompt, first=first, second=second)
