"""Preference rows: a good answer, a worse one, and why."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import fixed, wording
from pairloom.config import AnswerConfig
from pairloom.functions.draws import digest, draw, pick
from pairloom.functions.prompts import degradation_prompt, degradation_system, fallback_response, prompt_text
from pairloom.functions.scoring import answer_score, clamped_gap
from pairloom.functions.text import SENTENCE, ColumnOrName, col, or_empty, render, sentences
from pairloom.operators.indexing import require_unique
from pairloom.operators.ranking import first_n
from pairloom.operators.responder import Ask, respond
from pairloom.session import fresh_dir

ADD_IRRELEVANT = "add_irrelevant"
COUNT_SLOT, REASON_SLOT = 0, 1


def strategy(index: ColumnOrName, names: Sequence[str] = fixed.STRATEGIES) -> Column:
    """Round robin over the strategies."""
    return pick(names, F.pmod(col(index), F.lit(len(names))).cast("int"))


def other_strategy(index: ColumnOrName, first: ColumnOrName, names: Sequence[str] = fixed.STRATEGIES) -> Column:
    """Second choice: round robin, one step on, over the strategies without the first."""
    rest = F.array_remove(F.array(*[F.lit(n) for n in names]), col(first))
    return F.get(rest, F.pmod(col(index) + 1, F.size(rest)).cast("int"))


def chosen_side(sft: DataFrame, key: str = "sft_index") -> DataFrame:
    return sft.select(
        key,
        prompt_text("instruction", "input").alias("prompt"),
        or_empty("output").alias("chosen"),
        F.coalesce("topic", F.lit("Unknown")).alias("topic"),
        F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
    )


def _joined(pieces: Column) -> Column:
    return F.when(F.size(pieces) > 0, F.concat(F.array_join(pieces, ". "), F.lit("."))).otherwise("")


def weaken(
    text: ColumnOrName, how: ColumnOrName, spare: ColumnOrName, seed: int = fixed.SPLIT_SEED, hedge: str = wording.HEDGE
) -> Column:
    """A worse answer by rule; null for ``add_errors`` and unknown strategies."""
    text, how = col(text), col(how)
    parts = sentences(text)
    keyed = F.transform(parts, lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), x)).alias("h"), x.alias("s")))
    first = F.regexp_extract(text, SENTENCE, 0)
    return (
        F.when(how == "oversimplify", F.when(first != "", F.concat(first, F.lit("."))).otherwise(""))
        .when(how == "make_vague", F.concat(F.lit(hedge), F.regexp_replace(text, "[0-9]+", "")))
        .when(
            how == ADD_IRRELEVANT,
            F.when(or_empty(spare) != "", F.concat(text, F.lit(" "), col(spare), F.lit("."))).otherwise(text),
        )
        .when(how == "disorganize", _joined(F.transform(F.array_sort(keyed), lambda x: x["s"])))
        .when(how == "incomplete", _joined(F.slice(parts, 1, F.greatest(F.floor(F.size(parts) / 2), F.lit(1)).cast("int"))))
    )


def with_spare_sentence(
    df: DataFrame,
    text: str,
    needed: Column,
    key: str = "sft_index",
    group: str = "topic",
    block: int = 1000,
    out: str = "spare",
) -> DataFrame:
    """First sentence of the next row of the same group, for the rows that need one; null
    for the others.

    Groups are cut into blocks of ``block`` consecutive keys, which bounds each window
    whatever the size of the group; the last row of a block takes from its first. Only
    keys and first sentences enter the window. The result comes back by key, so the texts
    are read once; the key must be unique, and a missing or repeated one is an error.
    """
    require_unique(df, key)
    bucket = F.floor(F.col(key) / block)
    window = Window.partitionBy("_group", "_bucket").orderBy(key)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donors = df.select(
        key,
        needed.alias("_needed"),
        F.col(group).alias("_group"),
        bucket.alias("_bucket"),
        F.regexp_extract(text, SENTENCE, 0).alias("_first"),
    )
    spare = (
        donors.withColumn(out, F.coalesce(F.lead("_first").over(window), F.first("_first").over(whole)))
        .filter("_needed")
        .select(key, out)
    )
    return df.join(spare, key, "left")


@dataclass(frozen=True)
class ByRule:
    """Weak answers by rule; what has no rule gets the fallback response."""

    seed: int = fixed.SPLIT_SEED
    block: int = 1000
    hedge: str = wording.HEDGE

    def prepare(self, df: DataFrame, key: str, *hows: str) -> DataFrame:
        needed = reduce(or_, [F.col(h).eqNullSafe(ADD_IRRELEVANT) for h in hows])
        return with_spare_sentence(df, "chosen", needed, key, "topic", self.block, "_spare")

    def reject(self, df: DataFrame, how: str, out: str, only: Column) -> DataFrame:
        weak = F.coalesce(weaken("chosen", how, "_spare", self.seed, self.hedge), fallback_response("prompt"))
        return df.withColumn(out, F.when(only, weak))

    def settle(self, df: DataFrame) -> DataFrame:
        return df


@dataclass(frozen=True)
class ByModel:
    """Weak answers from a model; a failed call gets the fallback response. ``settings`` go
    with every call, such as ``{"temperature": F.lit(fixed.DEGRADE_TEMPERATURE)}``."""

    open_fn: Callable[[], Ask]
    templates: Mapping[str, str] | None = None
    settings: Mapping[str, Column] | None = None
    batch: bool = False

    def prepare(self, df: DataFrame, key: str, *hows: str) -> DataFrame:
        return df

    def reject(self, df: DataFrame, how: str, out: str, only: Column) -> DataFrame:
        user = degradation_prompt("prompt", "topic", how, self.templates or wording.DEGRADE_USER)
        asked = F.when(only, user)
        answered = respond(
            df, degradation_system(how), asked, self.open_fn, fallback_response("prompt"), out=out, error="_error",
            settings=self.settings, batch=self.batch,
        )
        return answered.drop("_error")

    def settle(self, df: DataFrame) -> DataFrame:
        """Write the answers, so that neither a second round nor a lost task asks again."""
        path = fresh_dir(df.sparkSession, "answers")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def degrade(
    df: DataFrame, text: str, how: str, seed: int = fixed.SPLIT_SEED, key: str = "sft_index", group: str = "topic"
) -> DataFrame:
    """Add ``degraded``: the text made worse by the row's strategy."""
    ready = with_spare_sentence(df, text, F.col(how).eqNullSafe(ADD_IRRELEVANT), key, group, out="_spare")
    return ready.withColumn("degraded", weaken(text, how, "_spare", seed)).drop("_spare")


def sample_criteria(id_: ColumnOrName, names: Sequence[str] = tuple(fixed.CRITERIA_PHRASES), seed: int = fixed.SPLIT_SEED) -> Column:
    """Two or three criteria without replacement, in random order, by the row's id."""
    row = col(id_).cast("string")
    options = F.array(*[F.lit(n) for n in names])
    keyed = F.transform(options, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), row, x)).alias("h"), x.alias("n")))
    count = draw(digest(seed, row), COUNT_SLOT, 2) + 2
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["n"]), 1, F.least(count, F.lit(len(names))))


def criteria_text(
    names: ColumnOrName, phrases: Mapping[str, str] | None = fixed.CRITERIA_PHRASES, sep: str = " and "
) -> Column:
    """The criteria as phrases, or by name with ``phrases=None``."""
    if phrases is None:
        return F.array_join(col(names), sep)
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return F.array_join(F.transform(col(names), lambda n: F.element_at(table, n)), sep)


def reason(
    id_: ColumnOrName, names: ColumnOrName, templates: Sequence[str] = wording.REASONS, seed: int = fixed.SPLIT_SEED
) -> Column:
    slots = {
        "phrases": criteria_text(names),
        "names": criteria_text(names, None, ", "),
        "first": F.get(col(names), 0),
        "second": F.get(col(names), 1),
    }
    which = draw(digest(seed, id_), REASON_SLOT, len(templates))
    text = F.lit(None).cast("string")
    for i, template in enumerate(templates):
        text = F.when(which == i, render(template, **slots)).otherwise(text)
    return text


def retry_weak(
    df: DataFrame, rejecter: ByRule | ByModel, key: str = "sft_index", cfg: AnswerConfig = AnswerConfig()
) -> DataFrame:
    """One more try with the other strategy where the answers differ too little.

    Expects ``prompt, chosen, rejected, degradation_strategy, quality_difference`` and adds
    ``retried``; the second answer is kept even if it is no worse than the first.
    """
    if "_chosen_score" not in df.columns:
        df = df.withColumn("_chosen_score", answer_score("chosen", cfg))
    if "_other" not in df.columns:
        df = rejecter.prepare(df.withColumn("_other", other_strategy(key, "degradation_strategy")), key, "_other")
    weak = df.withColumn("retried", F.col("quality_difference") < cfg.weak_below)
    again = rejecter.reject(weak, "_other", "_again", F.col("retried"))
    retried = F.col("retried")
    gap = clamped_gap("_chosen_score", answer_score("_again", cfg))
    return again.withColumns(
        {
            "rejected": F.when(retried, F.col("_again")).otherwise(F.col("rejected")),
            "degradation_strategy": F.when(retried, F.col("_other")).otherwise(F.col("degradation_strategy")),
            "quality_difference": F.when(retried, gap).otherwise(F.col("quality_difference")),
        }
    ).drop("_again", "_other", "_spare", "_first", "_chosen_score")


PREFERENCE_COLUMNS = [
    "prompt", "chosen", "rejected", "reason", "criteria_used", "topic", "difficulty",
    "quality_difference", "degradation_strategy",
]


def build_preferences(
    sft: DataFrame,
    rejecter: ByRule | ByModel = ByRule(),
    cfg: AnswerConfig = AnswerConfig(),
    n: int | None = None,
    key: str = "sft_index",
    seed: int = fixed.SPLIT_SEED,
) -> DataFrame:
    """Preference rows for the first ``n`` instruction rows by key (all by default)."""
    if n is not None:
        sft = first_n(sft, n, key)
    base = chosen_side(sft, key).withColumn("_first", strategy(key))
    base = base.withColumn("_other", other_strategy(key, "_first"))
    tried = rejecter.settle(rejecter.reject(rejecter.prepare(base, key, "_first", "_other"), "_first", "rejected", F.lit(True)))
    tried = tried.withColumn("_chosen_score", answer_score("chosen", cfg)).withColumn(
        "quality_difference", clamped_gap("_chosen_score", answer_score("rejected", cfg))
    )
    kept = retry_weak(tried.withColumn("degradation_strategy", F.col("_first")), rejecter, key, cfg)
    judged = kept.withColumn("criteria_used", sample_criteria(key, seed=seed))
    return judged.withColumn("reason", reason(key, "criteria_used", seed=seed)).select(*PREFERENCE_COLUMNS, key)
