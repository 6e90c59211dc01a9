"""Reading a judge's JSON reply."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.text import ColumnOrName, col, strip

FENCE = "```json"


def strip_fence(c: ColumnOrName) -> Column:
    """Remove a code fence, only where the reply starts with one."""
    c = col(c)
    bare = strip(F.btrim(F.btrim(strip(c), F.lit("`json")), F.lit("`")))
    return F.when(F.startswith(c, F.lit(FENCE)), bare).otherwise(c)


def is_json(c: ColumnOrName) -> Column:
    return F.try_parse_json(col(c)).isNotNull()


def members(c: ColumnOrName) -> Column:
    """Top-level members of a JSON object, each kept as its raw text."""
    return F.from_json(col(c), "map<string,string>")


def scores(raw: ColumnOrName) -> Column:
    """Points by criterion; null unless the member is an object of numbers."""
    return F.from_json(col(raw), "map<string,double>")


def model_total(points: ColumnOrName) -> Column:
    """Sum of a score map; null (not available) for a missing map."""
    return F.aggregate(F.map_values(col(points)), F.lit(0.0), lambda total, x: total + x)
