from __future__ import annotations

import json

import pytest

from codeloom.sources.nested import label_nodes, link_nodes, node_table, parse_payload
from codeloom.sources.repair import first_balanced, repair

REC = {
    "respondent": "A", "_meta": {"chunking": {"windows": [{"chunk": 0}]}},
    "segments": [None, {"segment_id": "S1", "codes": [{"dimension": "x"}, None, {"dimension": None}]}, {"segment_id": 7, "codes": {"dimension": "lone"}}],
    "open_segments": {"K1": {"open_codes": '[{"code_id": "c1"}]'}},
    "windows": [{"segments": [{"codes": [{"dimension": "w"}]}]}, None],
    "deleted_segments": [{"segment_id": None, "codes": [{"dimension": "d"}]}],
}


def found(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "raw_id bigint, payload string")
    rows = link_nodes(node_table(df)).filter("kind = 'code'").collect()
    return sorted((r.raw_id, r.record.pos, r.window.pos if r.window else -1, r.list_name, r.segment.pos, r.segment.ident, r.pos, r.ident) for r in rows)


def test_shapes(spark):
    one = json.dumps(REC)
    expect = [
        (0, "deleted_segments", -1, 0, "", 0, "d"), (0, "open_segments", -1, 0, "K1", 0, "c1"), (0, "segments", -1, 1, "S1", 0, "x"), (0, "segments", -1, 1, "S1", 2, ""),
        (0, "segments", -1, 2, "7", 0, "lone"), (0, "segments", 0, 0, "", 0, "w")]
    for raw in (one, "﻿" + one, json.dumps(one), json.dumps({"record": REC, "saved_by": "x"}), json.dumps({"export": {"version": 2, "records": [REC]}})):
        got = [(r[1], r[3], r[2], r[4], r[5], r[6], r[7]) for r in found(spark, [raw])]
        assert sorted(got) == sorted(expect)
    many = found(spark, [json.dumps([REC, {}, REC])])
    assert {r[1] for r in many} == {0, 2} and len(many) == 2 * len(expect)


def test_bad_payloads(spark):
    assert found(spark, [None, "", "not json", json.dumps(REC)[:-5], "{}", "[]", "3", '"text"']) == []
    assert [parse_payload(x)[0] for x in (None, " ", "{", "{}")] == ["null", "empty", "damaged", "ok"]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_intervals_nest():
    rows = label_nodes(REC)
    spans = {(k, p, q) for k, p, q, *_ in rows}
    inside = lambda a, b: a[1] < b[1] and a[2] > b[2]
    rec = next(s for s in spans if s[0] == "record")
    assert all(inside(rec, s) for s in spans if s[0] != "record")
    for c in (s for s in spans if s[0] == "code"):
        assert sum(inside(s, c) for s in spans if s[0] == "segment") == 1


@pytest.mark.parametrize(
    ("text", "value"),
    [('x {"a": [1, 2,],} y', {"a": [1, 2]}), ('```json\n{"a": "b"}\n```', {"a": "b"}), ('{"a": "l1\nl2"}', {"a": "l1\nl2"}), ('{"a": "}"} {"b": 1}', {"a": "}"}), ("none", None), (None, None), ("", None)],
)
def test_repair(text, value):
    out = repair(text)
    assert (json.loads(out) if out else None) == value
    assert first_balanced('a "x" [1, "]"] b') == '[1, "]"]'


def test_any_depth(spark):
    one = json.dumps(REC, ensure_ascii=False)
    deep = ["[" * n + one + "]" * n for n in (1500, 5000, 150_000)] + ['{"a": ' * n + one + "}" * n for n in (5000, 120_000)]
    got = found(spark, [one, *deep, "[" * 150_000 + one + "]" * 149_999, "[" * 150_000 + one + ",]" + "]" * 149_999])
    assert {g[0] for g in got} == set(range(6)) and all([g[1:] for g in got if g[0] == i] == [g[1:] for g in got if g[0] == 0] for i in range(1, 6))
    assert [parse_payload(x)[0] for x in deep] == ["ok"] * 5
    assert parse_payload('{"segments": [{"segment_id": ' + "[" * 60_000 + '"é"' + "]" * 60_000 + "}]}")[0] == "ok"
    rows = label_nodes({"segments": [{"segment_id": parse_payload("[" * 60_000 + '{"k": ["é", 1]}' + "]" * 60_000)[1], "codes": ["x"]}]})
    assert {r[5] for r in rows if r[0] == "segment"} == {"[" * 60_000 + '{"k": ["é", 1]}' + "]" * 60_000}


def test_deep_parser_agrees():
    from codeloom.sources.nested import _dump, _parse_deep

    for text in ('{"a": [1, -2.5e3, true, null, {"b": {}}, []], "c": "x\\u00e9\\n"}', "[]", "{}", ' [ [ ] , { "k" : [ 0 ] } ] ', '"s"', "3"):
        assert _parse_deep(text) == json.loads(text)
    for text in ("[1 2]", "[1,]", '{"a":}', '{"a" 1}', "{1: 2}", "[", "]", "[}", '{"a": 1]', "", "[] []", '{"a":1,}'):
        with pytest.raises(ValueError):
            _parse_deep(text)


def test_null_and_repeated_keys(spark):
    p = [json.dumps({"segments": [{"segment_id": f"S{i}", "codes": [f"c{i}"]}]}) for i in range(3)]
    df = spark.createDataFrame([(None, p[0]), (None, p[1]), (1, p[1]), (1, p[2])], "raw_id bigint, payload string")
    got = link_nodes(node_table(df)).filter("kind = 'code'").collect()
    assert sorted((r.raw_id or 0, r.segment.ident, r.ident) for r in got) == [(0, "S0", "c0"), (0, "S1", "c1"), (1, "S1", "c1"), (1, "S2", "c2")]
