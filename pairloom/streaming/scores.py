"""Scores of pairs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.config import ScoreConfig
from pairloom.operators.pairing import (
    PREFERENCE_FEATURES,
    SCORES,
    SFT_FEATURES,
    with_preference_features,
    with_scores,
    with_sft_features,
)


def scored_stream(pairs: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Scores of ``pair_id, sft, preference`` rows; works on a stream or a table."""
    both = with_preference_features(with_sft_features(pairs, cfg, "sft."), cfg, "preference.")
    return with_scores(both, cfg).select("pair_id", "sft_ok", "preference_ok", *SCORES)


def stream_scores(
    pairs: DataFrame, path: str, checkpoint: str, cfg: ScoreConfig = ScoreConfig()
) -> StreamingQuery:
    """Append the scores of all pairs that arrived since the last run, then stop.

    Stateless: the checkpoint remembers which files were read and the file sink commits
    each batch once, so a rerun after a lost executor or driver adds nothing twice.
    """
    return (
        scored_stream(pairs, cfg)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def joined_stream(
    sft: DataFrame,
    pref: DataFrame,
    delay: str = "1 hour",
    apart: str = "1 hour",
    cfg: ScoreConfig = ScoreConfig(),
    key: str = "sft_index",
    time: str = "ts",
) -> DataFrame:
    """Scores of pairs whose two sides arrive apart, as two streams (or tables).

    Both carry an event time; sides of a pair lie at most ``apart`` from each other, and an
    event comes at most ``delay`` late. Texts are reduced to features before the join, so
    the state holds some hundred bytes for each side that still waits, and drops it once
    the watermarks say that its partner cannot come any more. An instruction row without a
    partner comes out then, with null scores and ``matched`` false.
    """
    left = with_sft_features(sft, cfg).select(F.col(key).alias("pair_id"), F.col(time).alias("_at"), *SFT_FEATURES)
    right = with_preference_features(pref, cfg).select(F.col(key).alias("_key"), F.col(time).alias("_other"), *PREFERENCE_FEATURES)
    if sft.isStreaming:
        left, right = left.withWatermark("_at", delay), right.withWatermark("_other", delay)
    near = F.expr(f"_other BETWEEN _at - INTERVAL {apart} AND _at + INTERVAL {apart}")
    both = left.join(right, (F.col("pair_id") == F.col("_key")) & near, "left")
    matched = F.col("_key").isNotNull()
    scored = with_scores(both, cfg)
    return scored.select("pair_id", matched.alias("matched"), "sft_ok", "preference_ok", *[F.when(matched, F.col(c)).alias(c) for c in SCORES])


def stream_joined_scores(
    sft: DataFrame, pref: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", apart: str = "1 hour", cfg: ScoreConfig = ScoreConfig()
) -> StreamingQuery:
    """Append the scores of all pairs that became complete, or can no longer become so,
    since the last run, then stop. A restart goes on with the sides that wait."""
    return (
        joined_stream(sft, pref, delay, apart, cfg)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
