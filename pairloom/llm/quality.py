"""Quality scores by logistic regression on hashed word n-grams, trained with FTRL.

Words and runs of symbols are the tokens. Single tokens and neighbouring pairs are hashed
into a fixed number of slots. Training rows are dealt to shards; in each shard weights
follow the regularised leader, one text after the other, and the shards' weights are
averaged. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import scan


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that are learnt from; they are chosen by a
    hash of the id, so every run takes the same ones."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1.0
    epochs: int = 6
    shards: int = 4
    max_rows: int = 20_000


_LETTERS = scan.ALNUM
_SYMBOLS = ~scan.ALNUM & scan.PLAIN


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: how many, and the owner, slot and value of every feature. The
    values of a text have length 1."""
    data_all, offsets_all = scan.utf8(column)
    for i, j in scan.blocks(offsets_all):
        offsets = offsets_all[i : j + 1] - offsets_all[i]
        data = scan.LOWER[data_all[offsets_all[i] : offsets_all[j]]]
        a = scan.words(data, offsets, _LETTERS)
        b = scan.words(data, offsets, _SYMBOLS)
        starts = np.concatenate([a[0], b[0]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.concatenate([a[1], b[1]])[order]
        hashes = scan.Sums(data).of(starts, ends)
        firsts = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(j - i), np.diff(firsts))
        pair = scan.in_row(firsts, 2, len(starts))
        twice = pair & (hashes[:-1] == hashes[1:]) if len(hashes) > 1 else pair
        slot = np.concatenate([hashes, scan.grams(hashes, 2)[pair], np.full(int(twice.sum()), 0x5EED, np.uint64)])
        owner = np.concatenate([row, row[: len(pair)][pair], row[: len(twice)][twice]])
        key, count = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | (scan.mix(slot) >> np.uint64(64 - bits)), return_counts=True)
        owner, slot = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        value = 1 + np.log(count)
        length = np.sqrt(np.bincount(owner, value * value, minlength=j - i))
        yield j - i, owner, slot, value / length[owner]


def train_shard(texts: list, labels: list, settings: Settings) -> np.ndarray:
    """FTRL-proximal weights, slot 2 ** bits is the bias."""
    s, n = settings, 1 << settings.bits
    z, g2, rows = np.zeros(n + 1), np.zeros(n + 1), []
    for count, owner, slot, value in features(pa.array(texts, pa.string()), s.bits):
        cut = np.searchsorted(owner, np.arange(count + 1))
        for k in range(count):
            part = slice(cut[k], cut[k + 1])
            rows.append((np.append(slot[part], n).astype(np.int32), np.append(value[part], 1.0).astype(np.float32)))

    def weights(zi, gi):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(gi)) / s.alpha + s.l2)

    # Both classes weigh the same, however rare one of them is.
    share = [max(1, labels.count(y)) * 2 / len(labels) for y in (0.0, 1.0)]
    for _ in range(s.epochs):
        for (slot, value), y in zip(rows, labels, strict=True):
            zi, gi = z[slot], g2[slot]
            w = weights(zi, gi)
            error = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - y
            grad = error / share[int(y)] * value
            new = gi + grad * grad
            z[slot] = zi + grad - (np.sqrt(new) - np.sqrt(gi)) / s.alpha * w
            g2[slot] = new
    return weights(z, g2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    where: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
) -> np.ndarray:
    """Weights from the labelled rows that satisfy ``where`` (a condition on the id).

    At most ``max_rows`` labels are used, so the labels are sent to the texts and no text
    is shuffled but the chosen ones. Rows without label or id are not used; of several
    labels of an id the largest counts. Without any row all weights are 0.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & where)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(settings.max_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id").withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(settings.shards)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_h=pd.util.hash_array(part["_id"].to_numpy())).sort_values(["_h", "_id", "_text"])
        w = train_shard(part["_text"].tolist(), part["_y"].tolist(), settings)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    found = rows.groupBy("_shard").applyInPandas(fit, "w binary").collect()
    if not found:
        return np.zeros((1 << settings.bits) + 1, np.float32)
    return np.mean([np.frombuffer(r.w, np.float32) for r in sorted(found, key=lambda r: r.w)], axis=0)


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function from text to the score; null scores like empty text (the bias)."""
    known = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights) - 1).bit_length() - 1

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = known.value
        for column in columns:
            out = [np.empty(0)]
            for n, owner, slot, value in features(column, bits):
                out.append(1 / (1 + np.exp(-(np.bincount(owner, value * w[slot], minlength=n) + w[-1]))))
            yield pa.array(np.concatenate(out), pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()


def score_documents(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` (so any names may occur), and ``score``
    between 0 and 1, higher where label 1 is likelier."""
    return docs.select(F.struct("*").alias("row")).withColumn("score", scorer(docs, weights)(F.col("row").getField(text_col)))
