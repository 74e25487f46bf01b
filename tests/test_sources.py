from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.sources import docx, export, files, hearing
from tests.conftest import SF


def test_docx_round_trip(spark, tmp_path):
    text = "Speaker 1: first & line\nsecond <line>\n\nlast 中文"
    (tmp_path / "a.docx").write_bytes(docx.write_docx(text, [(0, 9, "yellow")]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("plain", "utf-8-sig")
    got = {r.path.rsplit("/", 1)[1]: r for r in docx.read_docx(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == text and got["b.docx"].text is None and got["b.docx"].error and got["c.txt"].text == "plain"
    assert docx.docx_marks(docx.write_docx(text, [(0, 9, "yellow")])) == [(0, 9, "Speaker 1", None)]
    assert docx.inline_tags("x [REF-N, RES-P] y [note]") == [(2, ["REF-N", "RES-P"])]


def test_docx_structure():
    w = docx.W[1:-1]
    body = "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Ann:</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>hello</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert docx.docx_text(out.getvalue()) == "new\n【Ann】hello\na\t\tb"


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"respondent": "A", "segments": [{"segment_id": "S1", "title": "t", "codes": []}]}), "utf-8")
    (tmp_path / "bad.json").write_text("{", "utf-8")
    p = files.read_payloads(spark, str(tmp_path))
    assert {r.status for r in p.collect()} == {"ok", "damaged"}
    assert [(r.segment_id, r.attrs["title"]) for r in files.record_segments(p).collect()] == [("S1", "t")]
    lex, bad = files.load_lexicon({"concept_terms": {"a": {"P": ["x"]}}, "patterns": [["p1", "a", "P", "("], ["p2", "a", "P", "y"]]})
    assert bad == ["p1"] and lex["terms"] == [["a", "P", "x"]] and files.load_lexicon(lex)[0] == lex
    target = tmp_path / "lex.json"
    files.save_lexicon(lex, str(target))
    with pytest.raises(ValueError):
        files.save_lexicon({"terms": []}, str(target))


def test_codebooks(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"codebook_id": f"cb{i}", "codes": [{"code_id": "c001", "label": "x", "count": 2}]}), "utf-8")
    cb = files.read_codebooks(spark, str(tmp_path))
    assert cb.count() == 2 and files.newest_codebook(cb).count() == 1


def test_hearing(spark):
    t = "COMMITTEE ON X\nThe CHAIR. What was the cost?\nMr. SMITH. It was high.\nIt went on.\nMEMBER FOR WARD SIX. And then?\nThe WITNESS. Then it fell."
    df = spark.createDataFrame([(1, t), (2, None)], "doc_id int, text string")
    qa = hearing.question_answers(hearing.turns(df)).orderBy("position").collect()
    assert [(r.question, r.answer) for r in qa] == [("What was the cost?", "It was high. It went on."), ("And then?", "Then it fell.")]
    s = spark.createDataFrame([("University of X",), ("Acme Inc.",), (None,), ("none",)], "a string").select(hearing.sector(F.col("a")).alias("s"))
    assert [r.s for r in s.collect()] == ["academia", "industry", "unspecified", "other"]


def test_export(spark, tmp_path):
    rec = spark.read.parquet(f"{SF}/records.parquet")
    one = json.loads(export.export_payload(rec).first().json)
    assert "_meta" in one and "segments" in one
    export.save_records(rec.limit(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception):
        export.save_records(rec.limit(3), str(tmp_path / "out"))
    export.write_tables({"a": rec.select("record_id"), "b": rec.select("respondent")}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/a")).count() == rec.count()
    docs = spark.createDataFrame([(1, "abc def"), (2, None)], "doc_id int, text string")
    pieces = spark.createDataFrame([(1, 0, 3, "green")], "doc_id int, start_pos int, end_pos int, colour string")
    got = {r.doc_id: r.content for r in export.highlighted(docs, pieces).collect()}
    assert docx.docx_marks(bytes(got[1])) == [(0, 3, "abc", None)]
    assert "中文" in export.structure_svg([("列", ["中文 entry"]), ("B", ["x" * 100])])
    names = export.unique_names(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "record_id int, n string"), F.col("n"))
    assert {r.file_name for r in names.collect()} == {"a_b.json", "a_b_2.json", "record.json"}
