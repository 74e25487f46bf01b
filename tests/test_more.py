"""Migration of records, comparison of marks, frame diagnostics, and small expressions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeloom.framework import Framework
from codeloom.operators import agreement, frame, lexicon, literature, longtable, marks, migrate
from codeloom.sources import export, files

FW = Framework.from_dict({"id": "ri", "dimensions": [{"id": "reflexivity", "short": "REF", "labels": {"en": "Reflexivity"}}, {"id": "engagement", "short": "ENG"}], "polarity": {"values": ["P", "N"]}, "descriptors": {"sector": ["ict"]}})


def test_migration(spark, tmp_path):
    old = {"受訪者": "A", "屬性": {"sector": "ICT", "x": 1}, "編碼段落": [
        {"段落ID": "S7", "標題": "t", "完整原文": "f", "編碼": [{"維度": "反思性", "極性": "n", "理由": "r"}, {"維度": "REF", "極性": "N", "理由": " r "}, {"維度": "nope", "極性": "N"}, {"維度": "REF"}, "x", {"維度": "REF", "極性": "P", "理由": "未表現出反省"}],
         "審核": {"狀態": "已確認", "來源": "人工", "編輯紀錄": [{"時間": "1", "動作": "a"}]}},
        {"codes": []}, {"codes": [], "review": {"source": "human"}}, {"codes": None, "review": {"source": "ai", "history": [{"time": "2"}]}}, None]}
    first = {"反思性": {"P": [{"完整原文": "same", "標題": "a"}], "N": [{"完整原文": "same"}, {"精簡引文": "q"}]}, "受訪者": ""}
    other = {"segments": [], "_meta": {"framework_id": "else", "source": "s"}}
    rows = [(1, json.dumps(old)), (2, json.dumps(first)), (3, json.dumps(other)), (4, "{"), (5, None), (6, "[1]"), (7, json.dumps({"segments": "x", "descriptors": [], "_meta": 3}))]
    got = {r.k: r for r in migrate.migrate_records(spark.createDataFrame(rows, "k int, payload string"), FW).collect()}
    a = json.loads(got[1].record)
    assert a["respondent"] == "A" and a["descriptors"] == {"sector": "ict"} and [s["segment_id"] for s in a["segments"]] == ["S7", "S003", "S004"]
    s = a["segments"][0]
    assert s["codes"] == [{"dimension": "reflexivity", "polarity": "N", "rationale": "r"}] and s["review"]["status"] == "confirmed" and s["review"]["source"] == "human" and s["review"]["history"][0]["action"] == "a"
    assert [d.reason for d in got[1].dropped] == ["duplicate", "unknown_dimension", "no_polarity", "malformed", "absence_as_evidence"]
    b = json.loads(got[2].record)
    assert b["respondent"] == "unknown" and [(x["full_text"], [c["polarity"] for c in x["codes"]]) for x in b["segments"]] == [("same", ["P", "N"]), ("q", ["N"])]
    assert got[3].mismatch and not got[1].mismatch and json.loads(got[3].record)["_meta"] == {"framework_id": "else", "source": "s", "schema_version": 3}
    assert [got[k].error for k in (4, 5, 6)] == ["damaged", "null", "no object"] and json.loads(got[7].record)["segments"] == []
    again = migrate.migrate_records(spark.createDataFrame([(k, r.record) for k, r in got.items() if r.record], "k int, payload string"), FW).collect()
    assert all(json.loads(r.record) == json.loads(got[r.k].record) and not r.dropped for r in again)
    (tmp_path / "r.json").write_text(json.dumps(old), "utf-8")
    assert [r.error for r in files.scan_records(spark, str(tmp_path), FW).collect()] == [None]


def test_compare_marks(spark):
    units = spark.createDataFrame([(f"U{i}", "r", "respondent", f"unit number {i} says something long") for i in range(4)] + [("U9", "r", "interviewer", "what is it that you say here")], "unit_id string, respondent string, role string, text string")
    mk = lambda *rows: spark.createDataFrame([("r", f"q{i}", q, c) for i, (q, c) in enumerate(rows)], "respondent string, quote_id string, quote string, codes array<string>")
    human = mk(("unit number 0 says something", ["A"]), ("unit number 1 says something", ["A", "B"]), ("nowhere to be found at all", ["B"]))
    model = mk(("unit number 0 says something", ["A"]), ("unit number 2 says something", ["B"]), ("what is it that you say", ["A"]))
    t = marks.compare_marks(units, human, model, ["A", "B"])
    pr = t["precision_recall"].first()
    assert (pr.precision, round(pr.recall, 4)) == (0.5, 0.3333) and {r.unit_id for r in t["differ"].collect()} == {"U1", "U2"}
    assert {(r.side, r.quote_id) for r in t["unplaced"].collect()} == {("human", "q2"), ("model", "q2")}
    cells = [(f"{u}{c}", v) for r in t["units"].collect() for u in [r.unit_id] for c in "AB" for v in (c in r.codes_a, c in r.codes_b)]
    brute = agreement.alpha_nominal(spark.createDataFrame([(u, str(v)) for u, v in cells], "unit_id string, value string")).first()
    mine = t["alpha"].first()
    assert mine.pairable == brute.pairable == 16 and abs(mine.alpha - brute.alpha) < 1e-12
    d = frame.frame_diagnostics(model, units).first()
    assert (d.quotes, d.framed, d.on_excluded, d.unmatched) == (3, 2, 1, 0)


def test_small_expressions(spark):
    df = spark.createDataFrame([(1, ("", "q")), (2, (None, "q")), (3, ("f", "q")), (4, None)], "k int, s struct<full_text:string,quote:string>")
    assert [r.t for r in df.orderBy("k").select(longtable.segment_text(F.col("s")).alias("t")).collect()] == ["q", "q", "f", None]
    rec = spark.createDataFrame([(1, "A", "x.txt"), (2, "A", None), (3, "B", "y"), (4, None, None)], "record_id int, respondent string, transcript_file string")
    assert {r.record_id: r.label for r in longtable.menu_labels(rec).collect()} == {1: "A (x.txt)", 2: "A (2)", 3: "B", 4: "unknown"}
    c = spark.createDataFrame([("A天b地", "One. Two，三；"), (None, None)], "t string, u string").select(lexicon.clean_cjk(F.col("t")).alias("t"), lexicon.clauses(F.col("u")).alias("u")).collect()
    assert (c[0].t, c[0].u, c[1].t, c[1].u) == ("　天　地", ["One", "Two", "三"], None, [])
    m = spark.createDataFrame([(1, ("a", "b")), (2, None)], "record_id int, _meta struct<source:string,framework_id:string>")
    assert [tuple(r._meta) for r in export.with_meta(m, source="new").orderBy("record_id").collect()] == [("new", "b"), ("new", None)]
    raw = json.dumps({"id": "https://x/T12", "display_name": "Trust", "works_count": 5, "field": {"display_name": "Soc"}})
    top = literature.suggest_topics(spark.createDataFrame([(2, "{}"), (1, raw)], "rank int, raw string")).collect()
    assert tuple(top[0]) == ("T12", "Trust", "", 5, "Soc") and tuple(top[1]) == ("", "", "", 0, "")
    works = spark.createDataFrame([(1, "On early warning", None), (2, None, "Early warning and cost"), (3, "None", "")], "work_id int, title string, abstract string")
    terms = spark.createDataFrame([("early warning",), ("cost",), ("absent",), ("",), (None,)], "term string")
    assert {r.term: r.works for r in lexicon.literature_terms(terms, works).collect()} == {"early warning": 2, "cost": 1}
    tok = spark.createDataFrame([("c", "x", 1), ("c", "x", 1), ("c", "x", 2), ("d", "x", None)], "code string, term string, doc_id int")
    ind = spark.createDataFrame([("c", "x"), ("d", "x")], "code string, term string")
    assert {r.code: r.doc_freq for r in lexicon.with_doc_freq(ind, tok).collect()} == {"c": 2, "d": 0}
    lx = spark.createDataFrame([("reflexivity", "t"), ("nope", "u"), ("nope", "v")], "dimension string, term string")
    fw = spark.createDataFrame([("ri", "reflexivity")], "framework_id string, dimension string")
    assert [(r.dimension, r.terms) for r in lexicon.lexicon_mismatch(lx, fw, "ri").collect()] == [("nope", 2)]
