"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        note = compare(spark, duck, FOLDER, QUERIES[name], SQL[name])
        assert note in ("", "no rows"), note
    else:
        assert len(QUERIES[name](spark, FOLDER).toArrow()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_cover_queries():
    assert set(SQL) <= set(QUERIES)
    own = {name for name in QUERIES if not name.startswith("op") and name != "pipeline"}
    assert own <= set(SQL)
