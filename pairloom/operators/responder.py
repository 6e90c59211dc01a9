"""The one Python hook: a user-supplied model call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import col

Ask = Callable[..., str]
AskMany = Callable[[list[dict[str, Any]]], Sequence[str | Exception]]


def _failed(e: Exception) -> tuple[None, str]:
    return None, f"{type(e).__name__}: {e}"


def _one_by_one(ask: Ask) -> AskMany:
    def ask_many(requests: list[dict[str, Any]]) -> list[str | Exception]:
        out: list[str | Exception] = []
        for r in requests:
            try:
                out.append(ask(r.pop("system"), r.pop("user"), **r))
            except Exception as e:  # a failed call marks its row and never the job
                out.append(e)
        return out

    return ask_many


def _answers(ask_many: AskMany, requests: list[dict[str, Any]]) -> list[tuple[str | None, str | None]]:
    try:
        answers = list(ask_many(requests)) if requests else []
        if len(answers) != len(requests):
            raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
    except Exception as e:
        return [_failed(e)] * len(requests)
    return [_failed(a) if isinstance(a, Exception) else (a.strip(), None) for a in answers]


def respond(
    df: DataFrame,
    system: Column | str,
    user: Column | str,
    open_fn: Callable[[], Ask | AskMany],
    fallback: Column | None = None,
    out: str = "response",
    error: str = "error",
    settings: Mapping[str, Column | str] | None = None,
    batch: bool = False,
) -> DataFrame:
    """Add the answer and, for a failed call, the error.

    ``open_fn`` runs once per task and gives ``ask(system, user, **settings)``; with
    ``batch=True`` it gives a callable for a list of such requests, as dicts, which returns
    an answer or an exception for each, so a model can work on many at a time. ``settings``
    are columns that go with a request, such as a temperature or a token limit; null ones
    are left out. Only the prompts and settings travel to Python. A null ``user`` is not
    sent, so a second round can skip the rows that need none. The number of partitions is
    the number of calls at a time. Calls are not repeatable: write the result before
    anything reads it twice, and resume with ``pending_by_key``.
    """
    names = list(settings or {})

    def ask_all(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        opened = open_fn()
        ask_many = opened if batch else _one_by_one(opened)
        for systems, users, *extra in batches:
            asked = [i for i, u in enumerate(users) if u is not None]
            requests = []
            for i in asked:
                more = {n: s.iloc[i] for n, s in zip(names, extra, strict=True)}
                requests.append({"system": systems.iloc[i] or "", "user": users.iloc[i], **{n: v for n, v in more.items() if not pd.isna(v)}})
            rows: list[tuple[str | None, str | None]] = [(None, None)] * len(users)
            for i, answer in zip(asked, _answers(ask_many, requests), strict=True):
                rows[i] = answer
            yield pd.DataFrame(rows, columns=["response", "error"], dtype=object)

    call = F.pandas_udf(ask_all, "response string, error string").asNondeterministic()
    asked = df.withColumn("_answer", call(col(system), col(user), *[col((settings or {})[n]) for n in names]))
    answer = F.col("_answer.response")
    if fallback is not None:
        answer = F.coalesce(answer, F.when(col(user).isNotNull(), fallback))
    return asked.withColumns({out: answer, error: F.col("_answer.error")}).drop("_answer")
