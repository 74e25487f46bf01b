from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.sentences import sentence_spans, split_sentences

CASES = [
    ["Dr. P. Holt came at 3 p.m. on Monday.", "He left at 5 p.m.", "Nobody asked."],
    ['The chair said it plainly: “We had no plan. We had a slide.”', "If so, why?"],
    ['"Is that it? Really?" was all they wrote.', "(Nobody took notes.)", "At 9:16 the gauge read 2.13 m."],
    ["Well... it was never fair, was it?", "They bought meters, cables, etc.", "In U.S. cities, e.g. there, it rose by 4.5% (see Fig. 8).", "Who signed?!", "iTally was off."],
    ["Die Kosten, d. h. rund 1.605,50 Euro, trug das Amt.", "Im 3. Stock wartete z. B. die Bibliothek.", "„Niemand fragte. Niemand“, sagte man."],
    ["Voir M. le maire, p. ex. avant 6 h.", "« Personne. Vraiment personne », a-t-on dit.", "Pourquoi attendre ?", "Les autres attendent !"],
    ["¿Por qué la Sra. alcaldesa llegó?", "¡Esperaron 51 días!", "Nadie."],
    ["主席說：「我們沒有計畫。我們只有投影片。」", "「沒有人問過。完全沒有。」居民這樣說。", "我們等了又等……還是沒有。", "誰簽的字？！"],
    ["議長は「計画はない。資料だけだ。」と言いました。", "なぜですか？"],
    ["उन्होंने कहा, “किसी ने नहीं पूछा। किसी ने नहीं।”", "डॉ. साहब आए।"],
    ["قالوا: «لم يسأل أحد. لا أحد.»", "أكد د. المدير ذلك.", "لماذا؟"],
]


@pytest.mark.parametrize("parts", CASES)
def test_joined(parts):
    text = ("" if parts[0][0] in "主議" else " ").join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_lines_gaps_and_glue():
    assert len(sentence_spans("no stop here\nnone there\n\n\nnor here")) == 3
    assert [len(sentence_spans(x)) for x in ("來了　走了", "One thing.Another thing.", "Write to a.b@mail.x.org now.", "ผมคิดว่าดี รอคำตอบ 7 วัน ประธานพูดว่า “ไม่มี ไม่มีเลย” เขาไป")] == [2, 2, 1, 4]
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n ") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA .!?…“”\"'()「」。\n1é中ก ا।", max_size=80))
def test_spans_are_a_partition(text):
    spans = sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(text) if not c.isspace())


def test_long_text():
    text = "We waited for the plan. " * 20_000
    assert len(sentence_spans(text)) == 20_000


def test_operator(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (1, "One. Two.", "x"), (2, None, "y"), (None, "Three", "z")], "id int, text string, start_pos string")
    assert sorted((r.id or 0, r.start_pos, r.end_pos) for r in split_sentences(df, ["id"], "text").collect()) == [(0, 0, 5), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert split_sentences(df.limit(0), ["id"], "text").count() == 0


def test_long_quotations():
    """Stops inside a quotation of any length end nothing, and the time grows with the text."""
    inner = "Well. I went there! Then I left. " * 3000
    for a, b in ("“”", "«»", '""', "„“", "()"):
        text = f"She said {a}{inner.strip()}{b} to us. Then she left."
        assert [text[i:j] for i, j in sentence_spans(text)][1:] == ["Then she left."], a
    text = f"She said: '{inner.strip()}' Then she left."
    assert len(sentence_spans(text)) == 2
    zh = "他說「{}」然後離開。再見。"
    assert len(sentence_spans(zh.format("我們去了。然後走了。" * 3000))) == len(sentence_spans(zh.format("我們去了。"))) == 3
    many = 'A "b" c. ' * 20_000
    start = time.perf_counter()
    sentence_spans(many)
    assert time.perf_counter() - start < 20


def test_unpaired_marks():
    assert len(sentence_spans('He said "no. Then he left. They met.')) == 3
    assert len(sentence_spans("“One. Two.\nThree. Four.”")) == 4
