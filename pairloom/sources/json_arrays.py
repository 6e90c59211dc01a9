"""JSON arrays of any layout, read in splits.

A scan that cuts at every closing brace can start anywhere in a file, but does not know
whether it stands inside a string, or how deep. Both follow from what lies before: the
parity of the quotes, and the sum of the brackets outside strings. Each piece is counted
for both cases; sums run over the pieces of a split, and over the splits of a file, of
which there are few. Pieces are then joined to elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

END = "}"


def _depth(text: Column) -> Column:
    """Opening less closing brackets."""
    n = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    return n("[{") - n("]}")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to each closing brace, with their place, and what they do to parity and
    depth if they begin outside a string (``_d0``) or inside one (``_d1``)."""
    # Bytes that are no UTF-8 stay as they are until the element is parsed.
    lines = spark.read.option("lineSep", END).text(path)
    place = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    plain = F.regexp_replace(F.concat("value", F.lit(END)), r"\\(?s:.)", "")
    parts = F.split(plain, '"', -1)
    outside = lambda odd: _depth(F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), ""))
    return place.withColumns({"_quotes": (F.size(parts) - 1) % 2, "_d0": outside(0), "_d1": outside(1)})


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, value``: the text of every element, an object, of the arrays in the files at
    ``path`` (one array each), in their order. A file that is not such an array is an error."""
    pieces = _pieces(spark, path)
    split = Window.partitionBy("_file", "_split").orderBy("_at")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # Inside its split: parity and depth for either way the split can begin.
    inner = pieces.withColumn("_odd", sums("_quotes", before) % 2)
    inner = inner.withColumns({"_e0": F.when(F.col("_odd") == 0, F.col("_d0")).otherwise(F.col("_d1")), "_e1": F.when(F.col("_odd") == 0, F.col("_d1")).otherwise(F.col("_d0"))})
    inner = inner.withColumns({"_l0": F.sum("_e0").over(split), "_l1": F.sum("_e1").over(split)})
    totals = inner.groupBy("_file", "_split").agg((F.sum("_quotes") % 2).alias("_q"), F.sum("_e0").alias("_t0"), F.sum("_e1").alias("_t1"), F.max("_at").alias("_last"))
    # Over the splits of a file: a row each.
    files = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_in", sums("_q", files) % 2).withColumn("_t", F.when(F.col("_in") == 0, F.col("_t0")).otherwise(F.col("_t1")))
    starts = starts.withColumn("_base", sums("_t", files))
    whole = Window.partitionBy("_file")
    starts = starts.withColumn("_tail", F.col("_split") == F.max("_split").over(whole)).select("_file", "_split", "_in", "_base", "_last", "_tail")
    known = inner.join(F.broadcast(starts), ["_file", "_split"])
    odd = (F.col("_odd") + F.col("_in") + F.col("_quotes")) % 2
    depth = F.col("_base") + F.when(F.col("_in") == 0, F.col("_l0")).otherwise(F.col("_l1"))
    # What follows the last brace of a file has none itself.
    rest = F.col("_tail") & (F.col("_at") == F.col("_last"))
    marked = known.select("_file", "_split", "_at", rest.alias("_rest"), F.when(rest, F.col("value")).otherwise(F.concat("value", F.lit(END))).alias("value"), (~rest & (odd == 0) & (depth == 1)).alias("_ends"))
    ended = F.coalesce(F.sum(F.col("_ends").cast("bigint")).over(before), F.lit(0))
    local = marked.withColumn("_local", ended)
    ends = marked.groupBy("_file", "_split").agg(F.sum(F.col("_ends").cast("bigint")).alias("_n"))
    first = ends.withColumn("_first", sums("_n", files)).drop("_n")
    numbered = local.join(F.broadcast(first), ["_file", "_split"]).withColumn("_no", F.col("_first") + F.col("_local"))
    joined = numbered.groupBy("_file", "_no").agg(
        F.array_sort(F.collect_list(F.struct("_split", "_at", "value"))).alias("_all"), F.max("_ends").alias("_whole"), F.max("_rest").alias("_rest")
    )
    text = F.array_join(F.transform("_all", lambda p: p["value"]), "")
    elements = joined.select(F.col("_file").alias("file"), F.col("_no").alias("at"), text.alias("_text"), "_whole")
    opening = F.when(F.col("at") == 0, r"\A[\s﻿]*\[\s*").otherwise(r"\A\s*,\s*")
    value = F.regexp_replace("_text", opening, F.lit(""))
    closing = F.when(F.col("at") == 0, F.col("_text").rlike(r"\A[\s﻿]*\[\s*\]\s*\z")).otherwise(F.col("_text").rlike(r"\A\s*\]\s*\z"))
    fits = F.when(F.col("_whole"), F.startswith(value, F.lit("{"))).otherwise(closing)
    wrong = F.raise_error(F.concat(F.lit("not an array of objects: "), F.left("_text", F.lit(200))))
    return elements.withColumn("value", F.when(fits, value).otherwise(wrong)).filter("_whole OR value IS NULL").select("file", "at", "value")


def read_array_splits(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The elements parsed; one that does not fit the schema fails the job."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")
    rows = array_elements(spark, path).select(F.explode(F.array(parsed)).alias("row"))
    return rows.select(*[F.col(f"row.`{n}`") for n in schema.names])
