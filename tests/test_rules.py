"""Rules whose results are fixed: absence as evidence, stand-in names, JSON repair, quotas of the sample."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import functions as F

from codeloom.functions.text import is_absence, is_placeholder, respondent_of_file
from codeloom.operators import coding, frame
from codeloom.sources.repair import repair

ABSENT = [
    "未表現出對自身假設或知識邊界的反省，僅強調遵循既定流程", "does not show any reflection on their own assumptions", "No evidence of upstream participation in this passage",
    "本段沒有提到任何外部意見的納入", "並未展現對技術侷限的認識", "看不出有任何雙向對話", "fails to demonstrate epistemic humility", "未體現任何前瞻思考"]
PRESENT = [
    "The absence of a review mechanism is stated plainly, including the respondent's own inaction", "Adaptation is structurally reactive; there is no trigger short of failure",
    "受訪者明言公司缺乏任何覆核機制", "受訪者說他們沒有做過任何情境規劃", "承認在設計過程中未能完全預見使用者行為", "坦言自己不是這個領域的專家", "", None]


def test_absence(spark):
    df = spark.createDataFrame([(t,) for t in ABSENT + PRESENT], "t string")
    got = {r.t: r.a for r in df.select("t", is_absence(F.col("t")).alias("a")).collect()}
    assert all(got[t] for t in ABSENT) and not any(got[t] for t in PRESENT)


def test_names(spark):
    stand_in = ["the respondent, as named in the interview transcript", "the person speaking, as named in the document", "未指定", "Respondent", "unknown", "N/A", "受訪者", "「無」", " participant ", "unnamed", "", None]
    df = spark.createDataFrame([(n,) for n in [*stand_in, "Patsy Calton"]], "n string")
    got = {r.n: r.p for r in df.select("n", is_placeholder(F.col("n")).alias("p")).collect()}
    assert [n for n in got if not got[n]] == ["Patsy Calton"]
    files = spark.createDataFrame([("some/dir/LY_2024 (final).docx",), ("transcript_A.txt",), (".hidden",), ("a.b.c",), ("",), (None,)], "f string")
    assert [r.n for r in files.select(respondent_of_file(F.col("f")).alias("n")).collect()] == ["LY_2024 (final)", "transcript_A", ".hidden", "a.b", "unknown", "unknown"]
    names = spark.createDataFrame([(1, "未指定", 0), (1, "the respondent", 1), (2, None, 0), (3, "A", 1), (3, "B", 0)], "k int, name string, ord int")
    assert {r.k: r.name for r in coding.merge_respondent(names, ["k"]).collect()} == {1: "unknown", 2: "unknown", 3: "B"}


def test_repair_leaves_strings():
    assert json.loads(repair('{"quote": "he said, } and then ,]", "n": 1,}')) == {"quote": "he said, } and then ,]", "n": 1}
    assert json.loads(repair('{"q": "a \\" ,} b", "xs": [1, 2,\n ], }')) == {"q": 'a " ,} b', "xs": [1, 2]}
    assert repair('{"a": }') is None and repair('{"a": "unterminated') is None


def test_every_code_gets_its_quota(spark):
    """Units that hold several codes serve each of them."""
    rows = [(f"A{i}", ["A"]) for i in range(300)] + [(f"B{i}", ["A", "B"]) for i in range(5)] + [(f"N{i}", []) for i in range(50)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, ["B"])], "unit_id string, ai_codes array<string>")
    for codes in (["A", "B"], ["B", "A"]):
        s = [r.unit_id for r in frame.stratified_sample(df, codes, n=30).collect()]
        n = Counter(u[0] for u in s)
        assert len(s) == len(set(s)) == 30 and n["N"] == 10 and n["B"] >= 4
    assert frame.stratified_sample(df.limit(0), ["A"]).count() == 0
