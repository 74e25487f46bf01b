from __future__ import annotations

import io
import zipfile

import pytest

from codeloom.sources import docx, report
from tests.conftest import SF


def test_workbook_round_trip():
    sheets = {"a/b": (["x", "y"], [(1, "<&>"), (None, None), (2.5, ["p", "q"]), (True, "\x01z")]), "A_B": (["c"], []), "": (["d"] * 30, [tuple(range(30))])}
    got = report.read_xlsx(report.write_xlsx(sheets))
    assert list(got) == ["a_b", "A_B_2", "sheet"]
    assert got["a_b"] == [["x", "y"], ["1", "<&>"], [], ["2.5", "p, q"], ["True", "z"]] and got["A_B_2"] == [["c"]] and got["sheet"][1] == [str(i) for i in range(30)]
    assert all(len(n) <= 31 for n in report.sheet_names(["n" * 40, "N" * 40, "n" * 40]))


def test_report_of_records(spark):
    rec, fw = spark.read.parquet(f"{SF}/records.parquet"), spark.read.parquet(f"{SF}/frameworks.parquet")
    tables = report.report_tables(rec, fw, ["institution_type", "sector"])
    assert {"long", "provenance", "endpoints", "tests", "coverage", "codes", "cooccurrence_segment", "cooccurrence_case", "case_matrix", "descriptors", "crosstab_sector"} <= set(tables)
    small = {k: tables[k] for k in ("endpoints", "codes", "crosstab_sector", "tests")}
    got = report.read_xlsx(report.workbook(small))
    assert len(got["codes"]) == fw.count() + 1 and got["crosstab_sector"][0] == ["by", "unit", "n", "pct"] and len(got["tests"]) > 1
    with pytest.raises(ValueError):
        report.workbook({"codes": tables["codes"]}, most=3)
    word = report.word_report("Report", [("Intro", "two\nlines"), ("Codes", tables["codes"])])
    text = docx.docx_text(word)
    assert text.startswith("Report\nIntro\ntwo\nlines\nCodes") and "short_code" in text
    assert report.read_xlsx(report.workbook({k: v.limit(0) for k, v in small.items()}))["codes"] == [tables["codes"].columns]


def test_marked_files():
    text = "One two three.\nFour five."
    marks = [(4, 7, "yellow", "A-P"), (8, 19, "green", "B-N, A-P")]
    data = report.marked_docx(text, marks)
    assert docx.docx_text(data) == text
    assert [(t.replace("\n", "|"), c) for _, _, t, c in docx.docx_marks(data)] == [("two", "A-P"), ("three.|Four", "B-N, A-P")]
    with_legend = report.marked_docx(text, marks, {"A: first": "yellow", "B: second": "green"})
    assert docx.docx_text(with_legend).startswith("A: first\nB: second\nOne")
    assert docx.docx_text(docx.write_docx("", [], [])) == "" and docx.docx_text(docx.write_docx("a\n\nb")).split("\n")[-1] == "b"
    z = zipfile.ZipFile(io.BytesIO(report.comparison_files("r1", text, marks, marks[:1], {"units": (["unit"], [("U1",)])})))
    assert sorted(z.namelist()) == ["r1_blank.docx", "r1_comparison.xlsx", "r1_human.docx", "r1_model.docx"]


def test_tags_are_stripped():
    plain, marks = docx.strip_tags("First. We asked them [ENG-P]. Then rain [REF-N, ANT-P]\nNo tag here")
    assert plain == "First. We asked them. Then rain\nNo tag here"
    assert [(plain[a:b], c) for a, b, c in marks] == [("We asked them", ["ENG-P"]), ("Then rain", ["REF-N", "ANT-P"])]
    assert docx.strip_tags("none") == ("none", [])
