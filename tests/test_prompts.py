from __future__ import annotations

import json

import pytest

from codeloom import prompts
from codeloom.framework import Framework, FrameworkError, FrameworkStore

FULL = {
    "id": "demo", "name": {"en": "Demo frame", "zh": "示範"}, "description": "About things.", "citation": "Someone 2020", "descriptors": {"sector": ["a", "b"]}, "corpus_terms": {"document": {"en": "audit report"}},
    "dimensions": [
        {"id": "one", "short": "ONE", "labels": {"en": "First", "zh": "一"}, "definition": {"en": "what is first"}, "indicators": {"P": {"en": ["asks early"]}, "N": ["never asks"]}, "exclusions": {"en": ["mere talk"]}, "literature": ["L1", "L2"]},
        {"id": "two", "short": "TWO"}],
    "polarity": {"values": ["P", "N"], "labels": {"": {"P": {"en": "present"}}, "one": {"N": {"zh": "負"}}}}}


def test_accessors():
    fw = Framework.from_dict(FULL)
    d = fw.dimensions[0]
    assert (fw.name("zh"), fw.name("fr"), fw.corpus_term("document"), fw.corpus_term("case")) == ("示範", "Demo frame", "audit report", "respondent")
    assert d.indicators("P") == ("asks early",) and d.indicators("N", "zh") == ("never asks",) and d.indicators() == () and d.exclusions("zh") == ("mere talk",)
    assert (fw.polarity_label("one", "P"), fw.polarity_label("one", "N", "zh"), fw.polarity_label("two", "N")) == ("present", "負", "N")
    assert fw.dimensions[1].label("zh") == "two" and fw.dimensions[1].definition() == ""
    assert Framework.from_dict(json.loads(json.dumps(fw.to_dict()))) == fw and hash(fw)
    flat = Framework.from_dict({"id": "f", "dimensions": [{"id": "a", "short": "A", "indicators": {"en": ["x"]}}]})
    assert flat.dimensions[0].indicators() == ("x",) and Framework.from_dict(flat.to_dict()) == flat


def test_store(tmp_path):
    store = FrameworkStore(tmp_path)
    with pytest.raises(FrameworkError):
        store.active()
    store.save(Framework.from_dict(FULL))
    (tmp_path / "broken.json").write_text("{")
    assert store.list() == ["demo"] and store.active().id == "demo"
    store.copy("demo", "other")
    with pytest.raises(FrameworkError):
        store.copy("demo", "other")
    store.activate("other")
    assert FrameworkStore(tmp_path).active().id == "other"
    with pytest.raises(FrameworkError):
        store.activate("broken")


def test_prompts():
    fw = Framework.from_dict(FULL)
    p = prompts.framework_prompt(fw, "zh-Hant")
    for part in ("Code an audit report", "Demo frame", "First (id one)", "asks early", "never asks", "Not First:", "mere talk", "L1; L2", "one | two", "P | N", "a | b | unspecified", "Traditional Chinese"):
        assert part in p, part
    bare = prompts.framework_prompt(Framework.from_dict({"id": "f", "dimensions": [{"id": "a", "short": "A"}]}))
    assert '"polarity"' not in bare and "language of the material" in bare
    codes = [{"label": f"c{i}", "count": i, "definition": "d" if i == 70 else None} for i in range(1, 71)]
    block = prompts.codebook_block(codes)
    assert block.startswith("- c70 [70]: d") and block.count("\n") == 60 and "10 rarer" in block and "- c10 " not in block
    assert "empty" in prompts.open_prompt([]) and "Code a memo openly" in prompts.open_prompt(codes, term="memo")
    assert "G0001 [A-P] t: q" in prompts.theme_prompt([{"global_id": "G0001", "title": "t", "quote": "q", "existing_codes": ["A-P"]}])
    assert "P1 n: " in prompts.aggregate_prompt([{"provisional_id": "P1", "name": "n"}], fw)


def test_language():
    assert [prompts.analysis_language(a, b) for a, b in (("en", "zh"), ("auto", "zh"), ("auto", "en"), ("auto", "unknown"), ("xx", "en"))] == ["en", "zh-Hant", "en", "auto", "en"]
