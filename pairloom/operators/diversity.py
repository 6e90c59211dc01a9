"""Top rows that together cover most words, instead of rows that are alike."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import ColumnOrName, col, words
from pairloom.session import written

# Winners of this many parts meet in one task, and rows join a task's winners in such chunks.
FAN_IN = 16
CHUNK = 4096


def word_features(text: ColumnOrName) -> Column:
    """The distinct words of a text, lower-cased, as 64-bit hashes."""
    return F.array_distinct(F.transform(words(F.lower(col(text))), lambda w: F.xxhash64(w)))


def greedy(ids: list[int], features: list[np.ndarray], bonus: list[float], n: int) -> list[tuple[int, float]]:
    """Places of up to ``n`` rows in the order of their gain, and the gains: the number of
    features that no earlier choice has, plus the row's bonus. Equal gains go by id.

    A gain only falls as rows are chosen, so a row whose renewed gain still beats the
    others' old ones is the best, and most rows are never looked at again.
    """
    waiting = [(-(len(f) + b), i, p) for p, (i, f, b) in enumerate(zip(ids, features, bonus, strict=True))]
    heapq.heapify(waiting)
    # Features by number, so that a row's are looked up at once.
    ends = np.cumsum([0, *map(len, features)])
    names, number = np.unique(np.concatenate([*features, np.empty(0, np.int64)]), return_inverse=True)
    fresh = np.ones(len(names), bool)
    chosen: list[tuple[int, float]] = []
    while waiting and len(chosen) < n:
        _, id_, place = heapq.heappop(waiting)
        own = number[ends[place] : ends[place + 1]]
        now = (-(np.count_nonzero(fresh[own]) + bonus[place]), id_, place)
        if waiting and now > waiting[0]:
            heapq.heappush(waiting, now)
            continue
        fresh[own] = False
        chosen.append((place, -now[0]))
    return chosen


def _winners(batches: Iterator[pa.RecordBatch], n: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The greedy choice of one task, which holds the winners so far and a chunk of rows."""
    held: tuple[list, list, list] = ([], [], [])
    gains: list[float] = []

    def settle() -> None:
        nonlocal held, gains
        chosen = greedy(*held, n)
        held = tuple([part[p] for p, _ in chosen] for part in held)
        gains = [g for _, g in chosen]

    for batch in batches:
        ids, bonus = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        lists = batch.column(1)
        values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for i, id_ in enumerate(ids):
            held[0].append(id_)
            held[1].append(values[at[i] : at[i + 1]])
            held[2].append(bonus[i])
            if len(held[0]) >= n + chunk:
                settle()
        # The batch's memory is given back; what is kept is copied.
        held = (held[0], [np.array(f) for f in held[1]], held[2])
    if held[0]:
        settle()
        columns = [pa.array(held[0], pa.int64()), pa.array(held[1], pa.list_(pa.int64())), pa.array(held[2], pa.float64()), pa.array(range(1, len(gains) + 1), pa.int64()), pa.array(gains, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "features", "bonus", "rank", "gain"])


def diverse_top_n(
    df: DataFrame,
    n: int,
    features: Column,
    key: str = "sft_index",
    score: ColumnOrName | None = None,
    score_weight: float = 1.0,
    parts: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """``key, rank, gain`` of ``n`` rows chosen greedily for what they add: the features (such as
    ``word_features``) that no row chosen before has, plus ``score_weight`` times ``score``.

    Rows are dealt to ``parts`` by a hash of the key, a whole number that is unique; each part
    chooses ``n``, and the winners of ``FAN_IN`` parts meet and choose again until one part is left. A
    task holds the winners and a chunk of rows, and no row is compared with each other.
    Every choice is at least 1 - 1/e of the best one among the rows it is made from, since
    coverage has falling returns; with one part and ``chunk`` above the number of rows it is the plain greedy choice.
    A missing list is empty, a missing score or one below 0 counts 0; rows without key are left out.
    """
    spark = df.sparkSession
    bonus = F.lit(0.0) if score is None else F.greatest(F.coalesce(col(score).cast("double"), F.lit(0.0)), F.lit(0.0)) * score_weight
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(features, F.array().cast("array<bigint>")).alias("features"), bonus.alias("bonus")
    )
    kind = "id bigint, features array<bigint>, bonus double, rank bigint, gain double"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = rows
    while True:
        dealt = chosen.select("id", "features", "bonus").repartition(parts, "id")
        chosen = written(dealt.sortWithinPartitions("id").mapInArrow(lambda b: _winners(b, n, chunk), kind), "winners")
        if parts == 1:
            return chosen.select(F.col("id").cast(df.schema[key].dataType).alias(key), "rank", "gain")
        parts = max(1, parts // FAN_IN)
