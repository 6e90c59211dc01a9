"""The most frequent values of an open vocabulary, with exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import ColumnOrName, col
from pairloom.session import written

COUNTERS = 1024


def _counts(batch: pa.RecordBatch) -> pa.StructArray:
    """``values, counts`` of the strings in the lists of a batch, nulls left out."""
    return batch.column(0).flatten().drop_null().value_counts()


def _known(batches: Iterator[pa.RecordBatch], wanted: pa.Array) -> Iterator[pa.RecordBatch]:
    """The counts of the wanted values, once per task."""
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        seen = _counts(batch)
        place = pc.index_in(seen.field("values").cast(pa.string()), value_set=wanted)
        there = place.is_valid()
        total[place.filter(there).to_numpy()] += seen.field("counts").filter(there).to_numpy()
    yield pa.RecordBatch.from_arrays([wanted, pa.array(total)], names=["value", "n"])


def _summaries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries counters of one task: at most ``counters`` values; each count is too small
    by at most ``loss``, which the first row carries."""
    held, n, loss = pa.array([], pa.string()), np.empty(0, np.int64), 0
    for batch in batches:
        seen = _counts(batch)
        values, new = seen.field("values").cast(pa.string()), seen.field("counts").to_numpy().astype(np.int64)
        place = pc.fill_null(pc.index_in(values, value_set=held), -1).to_numpy()
        new[place >= 0] += n[place[place >= 0]]
        rest = np.ones(len(held), bool)
        rest[place[place >= 0]] = False
        held, n = pa.concat_arrays([values, held.filter(pa.array(rest))]), np.concatenate([new, n[rest]])
        if len(held) > counters:
            cut = int(np.partition(n, -counters - 1)[-counters - 1])
            loss += cut
            held, n = held.filter(pa.array(n > cut)), n[n > cut] - cut
    if len(held):
        losses = np.zeros(len(held), np.int64)
        losses[0] = loss
        yield pa.RecordBatch.from_arrays([held, pa.array(n), pa.array(losses)], names=["value", "n", "loss"])
    elif loss:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([loss])], names=["value", "n", "loss"])


def most_frequent(df: DataFrame, values: ColumnOrName, k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """``value, n, next_n``: the ``k`` most frequent strings of an array column, exactly counted,
    equal counts by value. No other value is more frequent than ``next_n``, the count of the
    next one.

    Grouping by value would shuffle every distinct one. Here each task keeps ``counters``
    counts, and the summaries are added up: a count is too small by at most the sum of
    the tasks' losses. Values that may be among the ``k`` are then counted in a second pass.
    Where the summaries cannot tell them from values they have lost, they are made again
    with four times as many counters. Reads ``df`` twice: give it something cheap to read.
    Lists reach the tasks' counters whole, without a row per value.
    """
    each = df.select(col(values).alias("values")).filter(F.size("values") > 0)
    while True:
        rows = written(each.mapInArrow(lambda b, c=counters: _summaries(b, c), "value string, n bigint, loss bigint"), "counters")
        summed = rows.filter(F.col("value").isNotNull()).groupBy("value").agg(F.sum("n").alias("n"))
        loss = rows.agg(F.coalesce(F.sum("loss"), F.lit(0))).first()[0]
        best = [r.n for r in summed.orderBy(F.desc("n")).limit(k + 1).collect()]
        # Nothing was lost, or even the next best is more frequent than what was lost can be.
        if not loss or (len(best) > k and best[-1] > loss):
            break
        counters *= 4
    least = best[-1] if len(best) > k else 0
    # As many as the summaries hold at most; every task gets them.
    candidates = pa.array([r.value for r in summed.filter(F.col("n") >= least - loss).collect()], pa.string())
    parts = each.mapInArrow(lambda b: _known(b, candidates), "value string, n bigint")
    counted = parts.groupBy("value").agg(F.sum("n").alias("n")).filter("n > 0")
    exact = counted.orderBy(F.desc("n"), "value").limit(k + 1).collect()
    following = exact[k].n if len(exact) > k else 0
    rows = [(r.value, r.n, following) for r in exact[:k]]
    return df.sparkSession.createDataFrame(rows, "value string, n bigint, next_n bigint")
