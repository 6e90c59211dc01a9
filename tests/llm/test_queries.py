"""Every query that has an SQL twin, on the given tables."""

from __future__ import annotations

import duckdb
import pytest

from pairloom.llm.oracle import ORACLES
from pairloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert expected
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(expected, key=repr)
