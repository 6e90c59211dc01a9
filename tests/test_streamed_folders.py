"""Tables that are folders of several files, read as streams."""

from __future__ import annotations

import pytest

from pairloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.mark.parametrize("name", ["stream_scores", "stream_profiles", "stream_progress"])
def test_a_folder_gives_what_its_file_gives(spark, sf, folders, name):
    assert sorted(map(repr, QUERIES[name](spark, folders).collect())) == sorted(map(repr, QUERIES[name](spark, sf).collect()))


@pytest.mark.parametrize("name", ["stream_scores", "stream_profiles", "stream_progress"])
def test_a_table_without_rows_gives_no_rows(spark, sf, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
