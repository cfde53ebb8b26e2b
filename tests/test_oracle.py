"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    run = entry.queries()[name]
    if name in SQL:
        assert compare(spark, FOLDER, run, SQL[name]) == []
    else:
        assert run(spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
