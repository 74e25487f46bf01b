"""Queries read their whole tables: every framework, coder, unit and record. sf0.01 has all four frameworks."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeloom.operators import frame, lexicon
from tests.oracle import compare, tables

SF = "/root/testdata/sf0.01"
Q, SQL = entry.core.queries(), entry.core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    tables(c, SF)
    return c


@pytest.mark.parametrize("name", sorted(k for k in SQL if k.endswith("_all")))
def test_all_pairs(spark, con, name):
    got = Q[name](spark, SF).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) == ""
    every = con.execute("SELECT DISTINCT framework_id, lower(trim(coder)) FROM codings JOIN units USING (unit_id)").fetchall()
    if name == "exact_set_all":
        assert set(zip(got.framework_id, got.coder)) == set(every) and len({f for f, _ in every}) == 4


def test_every_unit(spark, con):
    n = con.execute("SELECT count(*) FROM units").fetchone()[0]
    assert Q["dictionary_codes"](spark, SF).filter("codes is not null").count() == n
    per = {r.framework_id: r.n for r in Q["compare_coders"](spark, SF).select("framework_id", "n").distinct().collect()}
    assert per == dict(con.execute("SELECT framework_id, count(*) FROM units GROUP BY 1").fetchall())
    assert Q["audit_llm"](spark, SF).select("framework_id").distinct().count() == 4
    assert Q["adjudicated"](spark, SF).count() == con.execute("SELECT count(DISTINCT (unit_id, lower(trim(coder)))) FROM codings JOIN units USING (unit_id)").fetchone()[0]
    assert Q["yield_report"](spark, SF).count() == con.execute("SELECT count(DISTINCT record_id) FROM records WHERE record_id IS NOT NULL").fetchone()[0]


def test_samples(spark, con):
    got = {}
    for r in Q["sample_units"](spark, SF).collect():
        got.setdefault(r.framework_id, set()).add((r.unit_id, r.draw))
    units = spark.read.parquet(f"{SF}/units.parquet")
    codes = con.execute("SELECT framework_id, list(CASE WHEN p IS NULL THEN short_code ELSE short_code || '-' || p END ORDER BY dim_ord, i) FROM (SELECT *, unnest(CASE WHEN len(polarity_values) = 0 THEN [NULL] ELSE polarity_values END) AS p, generate_subscripts(CASE WHEN len(polarity_values) = 0 THEN [NULL] ELSE polarity_values END, 1) AS i FROM frameworks) GROUP BY 1").fetchall()
    for fw, own in codes:
        assert got[fw] == {(r.unit_id, r.draw) for r in frame.stratified_sample(units.filter(F.col("framework_id") == fw), own).collect()}, fw
    assert len(got) == 4


def test_records_without_segments(spark, tmp_path):
    bare = [{"respondent": "A"}, {"segments": None}, {"segments": []}, {"windows": []}, {"segments": [{"codes": [{"dimension": "x"}, {"dimension": "y"}]}]}]
    rows = [(1, json.dumps(bare)), (2, json.dumps({"respondent": "B", "segments": None})), (3, "{"), (4, json.dumps({"a": {"segments": [{}]}, "b": {"segments": []}}))]
    spark.createDataFrame(rows, "raw_id bigint, payload string").write.parquet(str(tmp_path / "raw_records.parquet"))
    got = sorted(tuple(r) for r in Q["p2_records"](spark, str(tmp_path)).select("raw_id", "rec_pos", "segments", "codes").collect())
    assert got == [(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 0), (1, 4, 1, 2), (2, 0, 0, 0), (4, 0, 0, 0), (4, 0, 1, 0)]


def test_cjk_fragments(spark):
    texts = ["他談數據分析的人。", "小數據分析也難。", "我做數據分析！", "我們喝茶", "他說我們走", "和我們談"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term for r in lexicon.discover_terms_cjk(df, pmi=0.0, entropy=0.0, top=None).collect()}
    assert "數據分析" in got and "我們" not in got
    assert not any(t.startswith(("的", "我們")) or t.endswith(("的", "也", "他", "我們")) for t in got)


def test_cjk_all_terms(spark, tmp_path):
    """More than 800 terms are reported."""
    pairs = [chr(0x5000 + 2 * i) + chr(0x5001 + 2 * i) for i in range(820)]
    rows = [(a + p + b, "zh") for p in pairs for a, b in (("天", "山"), ("水", "火"), ("木", "石"))]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert Q["discover_terms_cjk"](spark, str(tmp_path)).filter("length(term) = 2").count() > 800
