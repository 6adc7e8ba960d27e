"""Registered queries against DuckDB, and those without SQL against their kind of rows."""

from pathlib import Path

import pytest
from oracle import compare, database

from tsalign.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_a_query(number):
    assert [q for q in QUERIES if q.startswith(f"op{number}_")]


def test_entry_has_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
