from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm.pii import find_spans, luhn, mask, mask_text, mod97, pii_spans, taiwan_id

CASES = [
    ("Write to ann.lee+x@mail.test.org now.", "Write to [EMAIL] now."),
    ("Reach me at ann_lee [at] mail [dot] org if needed.", "Reach me at [EMAIL] if needed."),
    ("Is joe-12 at mail dot example still right?", "Is [EMAIL] still right?"),
    ("你可以寫信到ann＠mail.org找我。", "你可以寫信到[EMAIL]找我。"),
    ("My number is (202) 555-0107, call late.", "My number is [PHONE], call late."),
    ("She gave me 202 555 0104 ext. 85.", "She gave me [PHONE]."),
    ("我的電話是０９００－０００－５５８，晚上都在。", "我的電話是[PHONE]，晚上都在。"),
    ("Call zero seven seven zero zero, nine zero zero, one two three.", "Call [PHONE]."),
    ("My passport number is X00839823 here.", "My passport number is [IDNUM] here."),
    ("They wrote down 946-33-8186 as my insurance number.", "They wrote down [IDNUM] as my insurance number."),
    ("We live at Flat 3, 32b Marsh Road, Port Elm 00123, and like it.", "We live at [ADDRESS], and like it."),
    ("The letter went to P.O. Box 33, Newhaven.", "The letter went to [ADDRESS]."),
    ("Unsere Anschrift ist Lindenweg 78b, 00008 Altfurt.", "Unsere Anschrift ist [ADDRESS]."),
    ("I spoke to Ms. Ann van der Lee about it.", "I spoke to Ms. [NAME] about it."),
    ("My colleague grace lee checked the list.", "My colleague [NAME] checked the list."),
    ("Ask for J. M. Lee (07700 900 123).", "Ask for [NAME] ([PHONE])."),
    ("請找岑書硯，電話0900-000-253。", "請找[NAME]，電話[PHONE]。"),
]
CLEAN = [
    "The budget was 4 124 000 and nobody blinked.", "Ticket WP-681-19 was closed on 2023-06-14.", "Firmware 4.5.0 replaced unit QX-3893-12.", "Batch 455-512-003 passed on page 330.", "The crossing on Mill Street was slow.",
    "Grace periods ended, and Mercy Street was not on the agenda.", "We follow @town_watch like everybody else.", "It fell by 10.87% (see Fig. 86).", "La Sra. alcaldesa y el Sr. secretario llegaron.", "", " "]


@pytest.mark.parametrize(("text", "masked"), CASES)
def test_found(text, masked):
    assert mask_text(text) == masked


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert find_spans(text) == []


def test_validators():
    assert luhn("4539578763621486") and not luhn("4539578763621487") and mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33") and taiwan_id("A123456789") and not taiwan_id("A123456788")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([c for c, _ in CASES] + CLEAN + ["\n", "1234567890", "@", "Dr. "]), max_size=5))
def test_spans_are_disjoint_and_masking_keeps_the_rest(parts):
    text = " ".join(parts)
    spans = find_spans(text)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    rest, at = [], 0
    for a, b, *_ in spans:
        rest.append(text[at:a])
        at = b
    out = mask_text(text)
    for piece in [*rest, text[at:]]:
        assert piece in out


def test_operator(spark):
    df = spark.createDataFrame([(1, CASES[0][0], None), (2, None, CASES[4][0]), (3, "", "x")], "id int, full_text string, quote string")
    got = sorted((r.id, r.field_name, r.kind, r.start_pos, r.end_pos) for r in pii_spans(df, ["id"], ["full_text", "quote"]).collect())
    assert got == [(1, "full_text", "EMAIL", 9, 32), (2, "quote", "PHONE", 13, 27)]
    assert [r.m for r in df.select(mask(F.col("full_text")).alias("m")).collect()] == [CASES[0][1], None, ""]
    assert pii_spans(df.limit(0), ["id"], ["quote"]).count() == 0
