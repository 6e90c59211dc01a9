"""Training text, splits, token budget and token accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import fixed
from pairloom.config import ChatMarkers
from pairloom.functions.draws import share
from pairloom.functions.prompts import chat_prompt, chat_turns, eval_prompt
from pairloom.functions.text import ColumnOrName, col, first_words, or_empty
from pairloom.operators.indexing import hash_cut
from pairloom.operators.lookup import BROADCAST_ROWS, look_up
from pairloom.operators.strata import apportion, by_key, cuts, strata_sizes, with_strata
from pairloom.session import written
from pairloom.sources.resume import require_rows


def flag_incomplete(df: DataFrame) -> DataFrame:
    """Mark rows without instruction or output; they are kept."""
    empty = (or_empty("instruction") == "") | (or_empty("output") == "")
    return df.withColumn("incomplete", empty)


def valid_dpo(df: DataFrame) -> DataFrame:
    """Rows with all three texts; blanks count as text here."""
    return df.filter((F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != ""))


def chat_sft(df: DataFrame, m: ChatMarkers = ChatMarkers(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Chat text per instruction row; no rows at all is an error."""
    user = eval_prompt("instruction", "input")
    return require_rows(df, "instruction rows").select(*keep, chat_turns(user, "output", m).alias("text"))


def chat_dpo(df: DataFrame, m: ChatMarkers = ChatMarkers(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt, chosen and rejected text per valid row; none left is an error."""
    user = eval_prompt("prompt", "input") if "input" in df.columns else F.col("prompt")
    return require_rows(valid_dpo(df), "preference rows").select(*keep, chat_prompt(user, m).alias("prompt"), "chosen", "rejected")


def split_key(seed: int, *key: ColumnOrName) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in key]))


def split_exact(
    df: DataFrame, *key: str, ratio: float = fixed.TRAIN_RATIO, seed: int = fixed.SPLIT_SEED
) -> DataFrame:
    """Add ``split``: exactly ``floor(ratio * n)`` rows are ``train``, shuffled by a hash.

    The cut is found from counts over the key alone; the rows themselves are then only
    compared with it and never move. The counts run at once, and each pass reads the key
    again: cheap over Parquet, dear over a table that is still to be computed, which
    should be written first. The key must be unique; a repeat is seen only at the cut.
    """
    hashed = split_key(seed, *key)
    cut = hash_cut(df, hashed, ratio)
    return df.withColumn("split", F.when(hashed <= F.lit(cut), "train").otherwise("eval"))


def split_bucket(
    df: DataFrame, *key: str, ratio: float = fixed.TRAIN_RATIO, seed: int = fixed.SPLIT_SEED
) -> DataFrame:
    """Add ``split`` from the row alone; the share is approximate, no job runs before."""
    return df.withColumn("split", F.when(share(seed, *key) < ratio, "train").otherwise("eval"))


GROUP_DIGITS = 15


def group_number(seed: int, *key: ColumnOrName) -> Column:
    """60 bits of the key's hash; a missing part of the key is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), col(k).cast("string")), F.lit("-")) for k in key]
    hashed = F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *parts))
    return F.conv(F.substring(hashed, 1, GROUP_DIGITS), 16, 10).cast("bigint")


def split_grouped(
    df: DataFrame,
    group: Sequence[str],
    by: Sequence[str] = (),
    ratio: float = fixed.TRAIN_RATIO,
    seed: int = fixed.SPLIT_SEED,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``split``: rows with equal ``group`` columns (a prompt) are on the same side, and
    every stratum of ``by`` has its share on each.

    A stratum's groups are ordered by a hash, and ``train`` takes them from the front
    while they fit its quota, ``floor(ratio * n)`` apportioned over the strata. What is
    then short of the whole goes to the strata that lack most, as long as their next group
    fits. So each stratum differs from its quota by less than its next group, and ``train``
    is never above ``floor(ratio * n)``. A group whose rows lie in several strata counts for the smallest
    (missing first). Missing values are values like others.

    Only 60 bits of each group's hash are counted and shuffled. All cuts are refined
    together, and rows are compared with the cut of their stratum; those of the groups that
    span strata look their side up (``look_up``). Eager like ``split_exact``.
    """
    by, g = list(by), group_number(seed, *group)
    strata = F.struct(*[F.col(b) for b in by], F.lit(0).alias("_one"))
    rows = df.select(g.alias("_g"), strata.alias("_s"))
    groups = rows.groupBy("_g").agg(F.min("_s").alias("_s"), F.max("_s").alias("_other"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.select("_g", "_n", (~F.col("_s").eqNullSafe(F.col("_other"))).alias("_mixed"), "_s.*"), "groups")
    keys = [*by, "_one"]
    sizes = strata_sizes(groups, keys, "_n")
    quotas = apportion(sizes, int(sum(sizes.values()) * ratio))
    found = cuts(groups, keys, F.col("_g"), None, quotas, "_n")
    short = sum(quotas.values()) - sum(c.taken for c in found.values())
    for s in sorted(found, key=lambda s: (found[s].taken - quotas[s], by_key(s))):
        cut = found[s]
        if cut.next0 is not None and cut.next_weight <= short:
            short -= cut.next_weight
            cut.k0, cut.taken = cut.next0, cut.taken + cut.next_weight
    cut_rows = [(*s, c.k0) for s, c in found.items()]
    before = F.coalesce(F.col("_g") <= F.col("_cut"), F.lit(False))
    sides = with_strata(groups.filter("_mixed"), keys, cut_rows, "_cut bigint").select("_g", before.alias("_side"), "_n")
    marked = with_strata(df.withColumns({"_g": g, "_one": F.lit(0)}), keys, cut_rows, "_cut bigint")
    marked = look_up(marked, sides, "_g", "_n", limit)
    side = F.coalesce("_side", before)
    return marked.select(*df.columns, F.when(side, "train").otherwise("eval").alias("split"))


def token_budget(df: DataFrame, text: str = "text", n: int = fixed.TOKEN_BUDGET) -> DataFrame:
    """Add the first ``n`` white-space tokens, equal ``labels``, and whether more followed."""
    cut = df.withColumn("_pieces", first_words(text, n))
    return cut.withColumn("tokens", F.slice("_pieces", 1, n)).withColumns(
        {"labels": F.col("tokens"), "truncated": F.size("_pieces") > n}
    ).drop("_pieces")


def budget_ids(df: DataFrame, ids: str, n: int = fixed.TOKEN_BUDGET) -> DataFrame:
    """Add the first ``n`` token ids as ``input_ids``, equal ``labels``, and whether more
    followed; the ids come from a tokenizer called through ``hook.answer_all``."""
    return df.withColumns({"input_ids": F.slice(ids, 1, n), "truncated": F.size(ids) > n}).withColumn("labels", F.col("input_ids"))


def truncation_share(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("truncated").alias("n_truncated"),
        F.avg(F.size("tokens")).alias("avg_tokens"),
    )


def argmax(scores: ColumnOrName) -> Column:
    """Position of the first maximum, from 0."""
    c = col(scores)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def masked_accuracy(
    df: DataFrame, pred: str, label: str, ignore: int = fixed.IGNORED_LABEL, shift: int | tuple[int, ...] = 0
) -> DataFrame:
    """Share of equal tokens where the label counts; 0 where none does.

    Sequences are cut to the shorter one. ``shift=1`` compares each prediction with the
    next label. Several shifts give a row each, with the ``shift``, from one pass.
    """
    shifts = (shift,) if isinstance(shift, int) else shift
    p, l = F.col(pred), F.col(label)
    sums = []
    for s in shifts:
        later = F.slice(l, s + 1, F.greatest(F.size(l) - s, F.lit(0))) if s else l
        n = F.least(F.size(p), F.size(later))
        # 1 right, 0 wrong, null where the label does not count.
        marks = F.zip_with(
            F.slice(p, 1, n), F.slice(later, 1, n), lambda a, b: F.when(b != ignore, F.coalesce((a == b).cast("int"), F.lit(0)))
        )
        sums.append(F.array_compact(marks).alias(f"m{s}"))
    ones = lambda m: F.size(F.filter(m, lambda x: x == 1))
    totals = [
        F.struct(
            F.coalesce(F.sum(ones(f"m{s}")), F.lit(0)).alias("correct"),
            F.coalesce(F.sum(F.size(f"m{s}")), F.lit(0)).alias("total"),
            F.lit(s).alias("shift"),
        )
        for s in shifts
    ]
    rows = df.select(*sums).agg(F.array(*totals).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    out = rows.withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))
    return out.select("correct", "total", "accuracy", *([] if isinstance(shift, int) else ["shift"]))
