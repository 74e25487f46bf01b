from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions.labels import clean_label, clean_text
from codeloom.operators import openbook, themes


def test_books_grow(spark):
    seen = "seen:"

    def coder(text, codes):
        if text == "bad":
            raise ValueError("no answer")
        return [{"quote": text, "open_codes": [{"label": w} for w in text.split(",")] + [{"label": seen + "/".join(c["label"] for c in codes)}] * (text == "a,b")}]

    rows = [("k", 1, 0, "A, b"), ("k", 1, 1, "a,b"), ("k", 2, 0, "bad"), ("k", 2, 1, "NEW: c,**b**"), ("m", 1, 0, "a,b"), ("m", 1, 1, "")]
    df = spark.createDataFrame(rows, "codebook_id string, record_id int, chunk int, text string").repartition(5)
    got = sorted(openbook.grow_books(df, coder).collect(), key=lambda r: (r.codebook_id, r.record_id, r.chunk, r.code_pos or 0))
    k = [(r.record_id, r.chunk, r.code_id, r.label, r.created) for r in got if r.codebook_id == "k" and not r.error]
    assert k == [(1, 0, "c001", "A", True), (1, 0, "c002", "b", True), (1, 1, "c001", "A", False), (1, 1, "c002", "b", False), (1, 1, "c003", "seen:A/b", True), (2, 1, "c004", "c", True), (2, 1, "c002", "b", False)]
    assert [r.error for r in got if r.error] == ["ValueError: no answer"]
    assert [r.code_id for r in got if r.codebook_id == "m"] == ["c001", "c002", "c003"]


def test_clean_text_agrees(spark):
    labels = ["[9x] “Trust — the idea”。", "NEW: Early  warning.", "- *Cost*", "【x】 錢——多", None, "…", "a-b"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r.c for r in df.select(clean_label(F.col("l")).alias("c")).collect()] == [clean_text(x) if x is not None else None for x in labels]


def test_merge_keeps_examples(spark):
    e = lambda *q: [(x,) for x in q]
    codes = spark.createDataFrame([("k", "a", 3, e("1", "2")), ("k", "b", 2, e("3")), ("k", "c", 1, None)], "codebook_id string, label string, count int, examples array<struct<quote:string>>")
    mapping = spark.createDataFrame([("k", "b", "c"), ("k", "a", "c")], "codebook_id string, label string, into string")
    r = openbook.merge_codes(codes, mapping, examples=2).collect()
    assert len(r) == 1 and r[0]["count"] == 6 and r[0].merged_from == ["a", "b"] and [x.quote for x in r[0].examples] == ["1", "2"]


def test_reference_kinds(spark):
    uses = spark.createDataFrame([("1", "m"), ("2", "m"), ("1", "x"), ("3", "x"), ("4", "x"), ("9", "o"), (None, "u")], "unit_id string, label string")
    ref = spark.createDataFrame([("1", "D"), ("2", "D"), ("2", "E"), ("3", "E"), ("9", None)], "unit_id string, dimension string")
    codes = spark.createDataFrame([("m",), ("x",), ("o",), ("u",), (None,)], "label string")
    assert {r.label: (r.kind, r.dimension) for r in openbook.map_to_reference(uses, ref, codes).collect()} == {"m": ("mapped", "D"), "x": ("mixed", None), "o": ("outside", None), "u": ("unlocated", None)}
    with pytest.raises(ValueError):
        openbook.to_framework(spark.createDataFrame([], "codebook_id string, code_no int, code_id string, label string"))


def test_batches():
    assert themes.fit_batch([10] * 100, None) == 60 and themes.fit_batch([10] * 100, 600) == 60 and themes.fit_batch([10] * 100, 599) == 50
    assert themes.fit_batch([10] * 100, 155) == 15 and themes.fit_batch([10] * 100, 50) == 5 and themes.fit_batch([10] * 100, 49) is None and themes.fit_batch([], 1) == 60


def test_themes_of_any_shape(spark):
    old = {"主題ID": "T01", "主題名稱": "n", "聚合維度": "反思性", "框架關係": "延伸", "極性傾向": "N", "構成ID": ["G0001"], "合併自": ["a"]}
    t = themes.migrate_theme(old, 1, ["reflexivity"], {"反思性": "reflexivity"})
    assert (t["theme_id"], t["aggregate_dimension"], t["frame_relation"], t["polarity_tendency"], t["member_ids"], t["merged_from"]) == ("T01", "reflexivity", "extends", "N", ["G0001"], ["a"])
    assert themes.migrate_theme(t, 9, ["reflexivity"]) == t
    df = spark.createDataFrame([(json.dumps({"聚合維度": "x", "框架關係": "y", "極性傾向": "z"}), 5), (None, 6), ("[", 7)], "theme string, number int")
    got = themes.migrate_themes(df, ["a"]).orderBy("number").collect()
    assert [(r.theme_id, r.aggregate_dimension, r.frame_relation, r.polarity_tendency) for r in got] == [(f"T0{i}", "unassigned", "aligned", "mixed") for i in (5, 6, 7)]


def test_second_stage(spark):
    prov = spark.createDataFrame([(0, "x", ["G1", "G2"]), (0, "y", ["G3"]), (1, "z", ["G2", "G4"])], "batch int, name string, member_ids array<string>")

    def generate(given):
        assert [(g["provisional_id"], g["name"]) for g in given] == [("P001", "x"), ("P002", "y"), ("P003", "z")]
        return [{"name": "final", "aggregate_dimension": "d", "merged_from": ["P001", "P003"]}, {"name": "rest", "merged_from": ["P002", "P999"]}]

    t, m = themes.aggregate(prov, generate, ["d"])
    assert [(r.theme_id, r.theme_name, r.aggregate_dimension) for r in t.orderBy("theme_id").collect()] == [("T01", "final", "d"), ("T02", "rest", "unassigned")]
    assert sorted((r.theme_id, r.global_id) for r in m.collect()) == [("T01", "G1"), ("T01", "G2"), ("T01", "G4"), ("T02", "G3")]
