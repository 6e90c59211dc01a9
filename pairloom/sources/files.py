"""Reading and writing datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from pairloom.functions.text import NON_SPACE
from pairloom.sources.json_arrays import read_array_splits

CORRUPT = "_corrupt"


def _struct(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """Parse ``value``; ``_corrupt`` keeps the text of a line that failed.

    The row comes out of a generator: a filter on it stays above, so that each line is
    parsed once.
    """
    wide = StructType(schema.fields).add(CORRUPT, StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select("value", F.explode(F.array(F.from_json("value", wide, options))).alias("row"))


def read_jsonl(
    spark: SparkSession, path: str, schema: str | StructType, bad: str = "quarantine"
) -> tuple[DataFrame, DataFrame] | DataFrame:
    """One JSON object per line, blank lines skipped, in a splittable scan.

    ``bad="quarantine"`` gives ``(good, bad)`` with the broken lines as ``value``;
    ``bad="fail"`` gives one table and fails the job on a broken line.
    """
    struct = _struct(schema)
    if bad == "fail":
        return spark.read.schema(struct).option("mode", "FAILFAST").json(path)
    if bad != "quarantine":
        raise ValueError("bad must be 'quarantine' or 'fail'")
    rows = _parsed(spark.read.text(path).filter(F.col("value").rlike(NON_SPACE)), struct)
    broken = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    good = rows.filter(~broken).select(*[F.col(f"row.`{n}`") for n in struct.names])
    return good, rows.filter(broken).select("value")


def read_json_array(
    spark: SparkSession, path: str, schema: str | StructType, indent: int | None = None
) -> DataFrame:
    """A file holding one JSON array.

    An array of any layout is read in splits whose pieces are then joined to elements, by
    a shuffle of the text (``json_arrays``). For an array written with a fixed indentation
    give ``indent`` and save the shuffle: a raw line break never occurs inside a JSON
    string, so the text between two elements is a record separator.
    """
    struct = _struct(schema)
    if indent is None:
        return read_array_splits(spark, path, struct)
    pad = " " * indent
    pieces = spark.read.option("lineSep", f"\n{pad}}},\n{pad}{{\n").text(path)
    # Every piece is the body of one object; only the first and last carry the brackets.
    body = F.regexp_replace("value", rf"\A\s*\[\n{pad}\{{\n|\n{pad}\}}\n\]\s*\z", "")
    lines = pieces.filter(~F.col("value").rlike(r"\A\s*\[\s*\]\s*\z"))
    parsed = _parsed(lines.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value")), struct)
    whole = F.when(
        F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull(),
        F.raise_error(F.concat(F.lit("not an object of the array: "), F.substring("value", 1, 200))),
    ).otherwise(F.col("row"))
    return parsed.select(whole.alias("row")).select(*[F.col(f"row.`{n}`") for n in struct.names])


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """``overwrite`` replaces what is there, ``continue`` adds to it.

    ``df`` must not read from ``path`` when overwriting.
    """
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"unknown format {fmt}")
    modes = {"overwrite": "overwrite", "continue": "append"}
    df.write.mode(modes[mode]).format(fmt).save(path)


def peek(df: DataFrame, n: int = 3) -> DataFrame:
    """First rows, to look at the columns before a run."""
    return df.limit(n)
