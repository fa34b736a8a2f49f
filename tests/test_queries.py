from __future__ import annotations

import os

import pytest

from linewright.queries import BINDINGS
from oracle import TABLES, compare, connect

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(BINDINGS))
def test_same_as_sql(spark, con, name):
    rows, problems = compare(
        BINDINGS[name][0](spark, SF_DIR), con, BINDINGS[name][1]
    )
    assert not problems, "\n".join(problems)
    assert rows > 0


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "pos", "line", "is_hit"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The small tables as folders of several files each, as large tables are."""
    root = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def small(spark):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(BINDINGS))
def test_same_on_tables_of_several_files(spark, folders, small, name):
    rows, problems = compare(BINDINGS[name][0](spark, folders), small, BINDINGS[name][1])
    assert not problems, "\n".join(problems)


def test_every_query_has_an_oracle_or_is_listed():
    assert all(sql for _, sql in BINDINGS.values())
