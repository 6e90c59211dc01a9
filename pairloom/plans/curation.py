"""The whole selection: pair, score, keep the best, give both sides back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pairloom import fixed
from pairloom.config import ScoreConfig
from pairloom.operators.pairing import score_pairs
from pairloom.operators.ranking import top_n, top_n_per
from pairloom.operators.strata import quota_top_n
from pairloom.session import written

# Ids and scores of this many pairs, 16 bytes each, are sent to every executor.
BROADCAST_IDS = 1_000_000


def best_pairs(
    sft: DataFrame,
    pref: DataFrame,
    n: int = fixed.TARGET_PAIRS,
    cfg: ScoreConfig = ScoreConfig(),
    gated: bool = False,
    per: str | None = None,
    key: str = "sft_index",
    quota: Sequence[str] = (),
) -> DataFrame:
    """``pair_id`` and ``score`` of the kept pairs: the narrow half of the work.

    By default the gates only add points, so a failing pair can still be kept;
    ``gated=True`` keeps passing pairs only. ``per`` keeps ``n`` for each value of a
    column of the instruction side; ``quota`` divides ``n`` over the values of such columns
    as they occur among the pairs, so the selection does not drift to easy rows. The scores
    are then written once, since their cuts are counted in several passes.
    """
    scored = score_pairs(sft, pref, cfg, key, keep=(per,) if per else tuple(quota))
    if gated:
        # Positive exactly where both gates pass. Said of the joined row, the filter stays
        # above the join; a filter on one side's gate would move below the features and
        # have Spark work them out twice.
        scored = scored.filter("quality > 0")
    if per:
        return top_n_per(scored.select("pair_id", "score", per), per, n).select("pair_id", "score", "rank")
    if quota:
        narrow = written(scored.select("pair_id", "score", *quota), "scores")
        return quota_top_n(narrow, quota, n).select("pair_id", "score")
    return top_n(scored.select("pair_id", "score"), n)


def curate_pairs(
    sft: DataFrame,
    pref: DataFrame,
    n: int = fixed.TARGET_PAIRS,
    cfg: ScoreConfig = ScoreConfig(),
    gated: bool = False,
    per: str | None = None,
    key: str = "sft_index",
    quota: Sequence[str] = (),
) -> DataFrame:
    """``pair_id, score, sft, preference`` of the kept pairs.

    The ids of the kept pairs go back to both tables, so only kept texts are joined to
    each other. They are broadcast where ``n`` bounds their number.
    """
    kept = best_pairs(sft, pref, n, cfg, gated, per, key, quota).select("pair_id", "score")
    if per is None and n <= BROADCAST_IDS:
        kept = F.broadcast(kept)
    left = sft.select(F.col(key).alias("pair_id"), F.struct("*").alias("sft")).join(kept, "pair_id")
    right = pref.select(F.col(key).alias("pair_id"), F.struct("*").alias("preference"))
    # Both sides carry the score, so both use the very same plan of ``kept`` and Spark
    # runs it once.
    return left.join(right.join(kept, "pair_id"), ["pair_id", "score"])
