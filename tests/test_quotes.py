"""Quotes located in units: both ways of comparing, the plan of the query, odd records."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeloom.operators import frame
from tests.conftest import SF
from tests.oracle import compare, tables


@pytest.mark.parametrize("compared", [0, 400, None])
def test_located_either_way(spark, monkeypatch, compared):
    """Keys compared directly and keys that go through grams give the same pairs, also where both occur."""
    if compared is not None:
        monkeypatch.setattr(frame, "COMPARED", compared)
    texts = [("x", "q1", "the harvest failed", "u1", "We said: the harvest, failed again."), ("x", "q2", "nothing", "u2", "nothing"), ("x", "q3", "twice the harvest failed. Then rain came", "u3", "the harvest failed"),
             ("x", "q3", "twice the harvest failed. Then rain came", "u3", "the harvest failed"), ("y", "q4", "the harvest failed", "u4", "the harvest failed"), ("z", "q5", None, "u5", "the harvest failed"),
             (None, "q6", "the harvest failed", "u6", "the harvest failed"), ("w", "q7", "——", "u7", "0123456789"), ("v", "q8", "0123 456 78", "u8", "012345678")]
    rows = spark.createDataFrame(texts, "respondent string, quote_id string, quote string, unit_id string, text string")
    quotes, units = rows.select("respondent", "quote_id", "quote"), rows.select("respondent", "unit_id", "text")
    assert sorted(map(tuple, frame.located(quotes, units).collect())) == [("u1", "q1"), ("u3", "q1"), ("u3", "q3"), ("u4", "q4")]
    assert sorted(r.respondent for r in frame.large_keys(quotes, units, "respondent").collect()) == {0: ["v", "w", "x", "y"], 400: ["x"]}.get(compared, [])


def test_quote_units_moves_texts_once(spark):
    """One shuffle for the quotes, one for the units, one for the pairs; no text is taken apart."""
    plan = entry.core.queries()["quote_units"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3 and "Generate" not in plan


def test_quote_units_odd_records(spark, tmp_path):
    """Null ids, null entries, null texts, records without segments and older versions, as in the SQL."""
    records = spark.read.parquet(f"{SF}/records.parquet")
    kept = records.filter("record_id is not null and size(segments) > 0")
    none = F.lit(None).cast(records.schema["segments"].dataType.elementType)
    blank = F.transform("segments", lambda s: F.when(F.length(s["quote"]) % 2 == 0, s.withField("quote", F.lit(None).cast("string"))).otherwise(s.withField("full_text", s["quote"])))
    odd = [kept.withColumn("segments", F.concat(F.array(none), "segments", F.array(none), "segments")).withColumn("record_id", F.col("record_id") + 100_000), kept.withColumn("segments", blank).withColumn("record_id", F.col("record_id") + 200_000),
           kept.withColumn("record_id", F.lit(None).cast("long")), kept.withColumn("segments", F.lit(None).cast(records.schema["segments"].dataType)).withColumn("record_id", F.col("record_id") + 300_000),
           kept.withColumn("segments", F.reverse("segments")).withColumn("saved_at", F.col("saved_at") - F.expr("interval 1 day"))]
    for x in odd:
        records = records.unionByName(x)
    records.coalesce(2).write.parquet(f"{tmp_path}/records.parquet")
    con = duckdb.connect()
    tables(con, str(tmp_path))
    found = entry.core.queries()["quote_units"](spark, str(tmp_path)).toPandas()
    assert len(found) > 500 and compare(found, con.execute(entry.core.oracle_sql()["quote_units"]).df()) == ""
