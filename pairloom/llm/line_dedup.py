"""Repeated lines by overlapping windows of three consecutive lines.

A window is three consecutive lines of one document. Of equal windows the first one
(smallest document id, then smallest position) stays; the lines under all later ones go.
Windows overlap, so the covered positions are merged before lines are cut, and windows
are judged on the input, not on what is left. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.tables import stored

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row per window: id, position and a 128-bit hash of its lines. The array of
    windows is built before it is exploded, so no row carries the text."""
    line = lambda i, k: F.get("_lines", i + k)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.split(text_col, "\n").alias("_lines")
    )
    window = lambda i: F.struct(
        i.cast("int").alias("pos"),
        F.xxhash64(*[line(i, k) for k in range(size)]).alias("h1"),
        F.xxhash64(F.lit(size), *[line(i, k) for k in reversed(range(size))]).alias("h2"),
    )
    rows = rows.filter(F.size("_lines") >= size)
    starts = F.sequence(F.lit(0), F.size("_lines") - size)
    return rows.select("_id", F.explode(F.transform(starts, window)).alias("_w")).select("_id", "_w.pos", "_w.h1", "_w.h2")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``_id`` and the start positions of its windows that occur earlier."""
    windows = stored(_windows(docs, id_col, text_col, size), "line-windows")
    # Counted in the map tasks first: a window with a third of all rows is one row per task.
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("_id", "pos")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    later = windows.join(first, ["h1", "h2"]).filter(F.struct("_id", "pos") != F.col("_first"))
    return later.groupBy("_id").agg(F.collect_set("pos").alias("_starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, then ``n_lines``, ``n_removed`` (long)
    and ``kept_text``.

    Lines end at a line feed; a text that ends with one has an empty last line. Null text
    has no lines and its kept text is empty; a text of fewer than three lines has no
    window and stays. Rows with the same id count as one document: a window that stands at
    the same place in both is not a repeat. Rows without an id take no part. Columns of
    any name may be present, as they stay inside ``row``.
    """
    marks = later_windows(docs, id_col, text_col, size)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_key"))
    text = F.col("row").getField(text_col)
    joined = rows.join(marks, rows["_key"] == marks["_id"], "left").withColumn(
        "_lines", F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    )
    n = F.size("_lines")
    covered = F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (size - 1))))
    kept = F.when(
        F.col("_starts").isNull(), F.col("_lines")
    ).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n - 1), covered), lambda i: F.get("_lines", i))
    )
    return joined.withColumn("_kept", kept).select(
        "row",
        n.cast("long").alias("n_lines"),
        (n - F.size("_kept")).cast("long").alias("n_removed"),
        F.array_join("_kept", "\n").alias("kept_text"),
    )
