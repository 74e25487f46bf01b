from __future__ import annotations

import duckdb
import pytest

from codeloom.llm import queries
from tests.conftest import SF
from tests.oracle import compare, tables

FOUND = {
    "p1_found": ["scope_id", "item_a", "item_b"], "p3_found": ["record_id", "segment_id", "start_pos", "end_pos"], "p4_found": ["unit_id", "dimension", "polarity"],
    "p5_found": ["record_id", "segment_id", "field_name", "kind", "start_pos", "end_pos"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    tables(con, SF)
    assert compare(queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()) == ""
