"""Every query with SQL gives the same rows in both engines; the others run."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, tables

CORE = entry.core.queries()
SQL = entry.core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    tables(c, SF)
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert compare(CORE[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    df = CORE[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
