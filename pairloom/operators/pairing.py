"""Pairing of instruction rows with preference rows, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.config import ScoreConfig
from pairloom.functions import scoring as s
from pairloom.functions.text import or_empty
from pairloom.operators.indexing import unique_key


def pair(sft: DataFrame, pref: DataFrame, key: str = "sft_index") -> DataFrame:
    """``pair_id`` and both rows as structs, joined on the key. A repeated or missing key is an
    error when the rows are read."""
    left = sft.select(F.col(key).alias("pair_id"), F.struct("*").alias("sft"))
    right = pref.select(F.col(key).alias("pair_id"), F.struct("*").alias("preference"))
    return unique_key(left, "pair_id").join(unique_key(right, "pair_id"), "pair_id")


def unpaired(sft: DataFrame, pref: DataFrame, key: str = "sft_index") -> DataFrame:
    return sft.join(pref.select(key), key, "left_anti")


def unzip_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pairs.select("sft.*"), pairs.select("preference.*")


def with_sft_features(df: DataFrame, cfg: ScoreConfig = ScoreConfig(), at: str = "") -> DataFrame:
    """Everything the pair score needs from the instruction side, as narrow columns."""
    text = df.withColumn("_text", s.sft_text(at))
    low = text.withColumns({"_low": F.lower("_text"), "sft_length": F.length("_text")})
    return low.withColumns(
        {
            "sft_ok": s.sft_gate(cfg.gate, at, "_text", lowered="_low", length="sft_length"),
            "sft_bits": s.category_bits("_low", cfg.categories),
            "sft_tail": F.right(F.col("_low"), F.lit(cfg.seam)),
            "sft_topic": F.col(at + "topic"),
            "diversity": s.diversity("_text", cfg, "sft_length"),
            "difficulty_score": s.difficulty_balance(at + "difficulty"),
        }
    ).drop("_text", "_low")


def with_preference_features(df: DataFrame, cfg: ScoreConfig = ScoreConfig(), at: str = "") -> DataFrame:
    text = df.withColumn("_text", s.preference_text(at))
    low = text.withColumns({"_low": F.lower("_text"), "preference_length": F.length("_text")})
    return low.withColumns(
        {
            "preference_ok": s.preference_gate(
                cfg.gate, at, "_text", lowered="_low", length="preference_length"
            ),
            "preference_bits": s.category_bits("_low", cfg.categories),
            "preference_head": F.left(F.col("_low"), F.lit(cfg.seam)),
            "preference_topic": F.col(at + "topic"),
        }
    ).drop("_text", "_low")


SFT_FEATURES = ["sft_ok", "sft_length", "sft_bits", "sft_tail", "sft_topic", "diversity", "difficulty_score"]
PREFERENCE_FEATURES = [
    "preference_ok", "preference_length", "preference_bits", "preference_head", "preference_topic",
]
SCORES = ["quality", "relevance", "diversity", "difficulty_score", "score"]


def category_hits(cfg: ScoreConfig) -> Column:
    """Categories hit in either text or, for a keyword with a space, across their joint."""
    seam_terms = [tuple(w for w in words if " " in w) for words in cfg.categories]
    bits = F.col("sft_bits").bitwiseOR(F.col("preference_bits"))
    if any(seam_terms):
        joint = F.concat("sft_tail", F.lit(" "), "preference_head")
        bits = bits.bitwiseOR(s.category_bits(joint, seam_terms))
    return bits


def with_scores(df: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Score columns from the feature columns of both sides in one row."""
    both_ok = F.col("sft_ok") & F.col("preference_ok")
    parts = df.withColumns(
        {
            "quality": s.basic_quality(both_ok, F.col("sft_length"), F.col("preference_length"), cfg),
            "relevance": s.domain_relevance(
                category_hits(cfg), or_empty("sft_topic"), or_empty("preference_topic")
            ),
        }
    )
    return parts.withColumn("score", s.total_score(*[F.col(c) for c in SCORES[:-1]], cfg))


def score_pairs(
    sft: DataFrame, pref: DataFrame, cfg: ScoreConfig = ScoreConfig(), key: str = "sft_index", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``pair_id``, gates and scores per pair.

    The texts are reduced to features before the join, so the shuffle carries some
    hundred bytes per pair instead of both texts. A repeated or missing key on either side
    is an error when the rows are read.
    """
    left = with_sft_features(sft, cfg).select(F.col(key).alias("pair_id"), *SFT_FEATURES, *keep)
    right = with_preference_features(pref, cfg).select(F.col(key).alias("pair_id"), *PREFERENCE_FEATURES)
    scored = with_scores(unique_key(left, "pair_id").join(unique_key(right, "pair_id"), "pair_id"), cfg)
    return scored.select("pair_id", "sft_ok", "preference_ok", *SCORES, *keep)
