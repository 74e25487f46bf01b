"""Operators against hand-computed or brute-force results."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.framework import Framework, FrameworkError, validate
from codeloom.functions.labels import clean_label
from codeloom.functions.segmenting import plan_windows, split_turns, suggest_interviewers, speakers, turns
from codeloom.functions.stats import gamma_q
from codeloom.functions.text import host_class, is_absence, respondent_of_file, script
from codeloom.operators import agreement, coding, cooccur, crosstab as ct, frame, lexicon, literature, longtable, marks, migrate, openbook, review, themes

# The hand-computed set: 4 respondents, 12 segments, 15 codes.
SET = {
    "產A": ("industry", ["REF-N RES-N", "ANT-N", "ENG-N", "RES-N"]), "產B": ("industry", ["REF-N RES-N", "ANT-P"]),
    "學C": ("academia", ["ENG-P", "REF-P", "ANT-P", "RES-P"]), "學D": ("academia", ["ENG-P REF-P", "RES-P"])}
CODES = [f"{d}-{p}" for d in ("ANT", "ENG", "REF", "RES") for p in "PN"]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(r, f"{r}{i}", c[:3], c[4:], c, inst) for r, (inst, segs) in SET.items() for i, s in enumerate(segs) for c in s.split()]
    return spark.createDataFrame(rows, "respondent string, segment string, dimension string, polarity string, code string, institution_type string")


def cells(df):
    return {(r.by, r.unit): r.n for r in df.collect()}


def test_crosstab(long):
    assert long.count() == 15
    c = cells(ct.crosstab(long, "institution_type", "code"))
    assert c["industry", "REF-N"] == 2 and c["industry", "RES-N"] == 3 and c["academia", "ENG-P"] == 2
    assert sum(v for (b, _), v in c.items() if b == "industry") == 8 and sum(v for (b, _), v in c.items() if b == "academia") == 7
    case = cells(ct.case_level(long, "institution_type", "code"))
    assert sum(case.values()) == 4 and case["academia", "mixed"] == 2


def test_cooccurrence(long, spark):
    p = {(r.code_a, r.code_b): (r.n, round(r.jaccard, 3)) for r in cooccur.cooccurrence(long, ["segment"]).collect()}
    assert p["REF-N", "RES-N"] == (2, 0.667) and p["ENG-P", "REF-P"][0] == 1
    case = {(r.code_a, r.code_b): r.n for r in cooccur.cooccurrence(long, ["respondent"]).collect()}
    assert case["ENG-P", "REF-P"] == 2
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    d = cooccur.dense(cooccur.cooccurrence(long, ["segment"]), cooccur.totals(long, ["segment"]), codes)
    assert d.count() == 64 and d.filter("code_a = 'RES-N' and code_b = 'RES-N'").first().n == 3


def test_balance_and_chi(long):
    b = {r.respondent: r["index"] for r in ct.polarity_balance(long, "P", "N").filter("dimension is null").collect()}
    assert b["產A"] == -1 and b["學C"] == 1 and round(b["產B"], 3) == -0.333
    t = ct.with_p(ct.chi_square(ct.crosstab(long, "institution_type", "code"))).first()
    assert t.verdict == "sparse" and t.p is None


def test_chi_published(spark):
    table = {"academia": (33, 15), "government": (22, 23), "industry": (16, 25), "nonprofit": (30, 17)}
    df = spark.createDataFrame([(k, u, n) for k, v in table.items() for u, n in zip("PN", v)], "by string, unit string, n bigint")
    t = ct.with_p(ct.chi_square(df)).first()
    assert round(t.chi2, 3) == 10.042 and round(t.p, 4) == 0.0182 and round(t.cramers_v, 3) == 0.236 and round(t.min_expected, 2) == 18.12 and t.dof == 3
    yates = ct.chi_square(spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "by string, unit string, n bigint")).first()
    assert yates.chi2 == pytest.approx(5.4) and yates.dof == 1


def test_gamma():
    assert gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert gamma_q(2, 0) == 1.0


def test_case_matrix_dense(long, spark):
    m = ct.case_matrix(long, spark.createDataFrame([(c,) for c in CODES], "code string"))
    assert m.count() == 32 and m.agg(F.sum("n")).first()[0] == 15


def test_binary_agreement(spark):
    a, b = "1111000000", "1110100000"
    r = agreement.binary_agreement(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")).first()
    assert (r.n, r.both_yes, r.neither, r.only_a, r.only_b) == (10, 3, 5, 1, 1)
    assert [round(x, 3) for x in (r.po, r.kappa, r.pabak, r.ac1)] == [0.8, 0.583, 0.6, 0.615]
    rows = [(1, 1)] + [(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 94
    p = agreement.with_bands(agreement.binary_agreement(spark.createDataFrame(rows, "a int, b int"))).first()
    assert p.po >= 0.94 and p.kappa < 0.4 and p.paradox and p.band == "fair"
    same = agreement.binary_agreement(spark.createDataFrame([(1, 1)], "a int, b int")).first()
    assert same.kappa is None
    assert agreement.binary_agreement(spark.createDataFrame([], "a int, b int")).first().po is None


def alpha(spark, *coders):
    rows = [(str(u), v) for c in coders for u, v in enumerate(c) if v is not None]
    return agreement.alpha_nominal(spark.createDataFrame(rows, "unit_id string, value int")).first()


def test_alpha(spark):
    n = None
    a, b = [1, 2, 3, 3, 2, 1, 4, 1, 2, n, n, n], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, n, 3]
    r = alpha(spark, a, b)
    assert r.pairable == 18 and round(r.alpha, 3) == 0.852
    assert round(alpha(spark, [1, 1, 1], [1, 1, 1], [0, 0, 0]).alpha, 3) < 0.6
    assert alpha(spark, [1, 2], [1, 2]).alpha == 1.0 and alpha(spark, [1, 2], [2, 1]).alpha < 0


def test_session(spark):
    t = {"U1": ["REF-N"], "U2": ["ENG-N"], "U3": ["ENG-P"], "U4": []}
    m = {"U1": ["REF-N", "RES-N"], "U2": ["ENG-P"], "U3": ["ENG-P"], "U4": []}
    c = spark.createDataFrame([(u, "t", x) for u, x in t.items()] + [(u, "m", x) for u, x in m.items()], "unit_id string, coder string, codes array<string>")
    al = agreement.align(c, "t", "m").cache()
    assert agreement.pooled(al, CODES).first().n == 32 and agreement.exact_set(al).first().exact == 0.5
    pc = {r.dimension: (r.agree, r.conflict) for r in agreement.polarity_confusion(al).collect()}
    assert pc["ENG"] == (1, 1)
    d = agreement.disagreements(al).collect()
    assert [r.kind for r in d] == ["polarity", "dimension"]
    pr = {r.code: r for r in agreement.precision_recall(al, CODES).collect()}
    assert pr["ENG-N"].recall == 0 and pr["ENG-N"].fn == 1 and pr["ENG-N"].f1 is None


def test_framework():
    data = {"id": "ri", "dimensions": [{"id": "ant", "short": "ANT", "labels": {"en": "Anticipation"}}, {"id": "eng", "short": "ENG"}], "polarity": {"values": ["P", "N"]}}
    fw = Framework.from_dict(data)
    assert fw.codes == ("ANT-P", "ANT-N", "ENG-P", "ENG-N") and fw.split_code("ENG-N") == ("eng", "N") and fw.split_code("X") == (None, None)
    assert fw.code_of("ant", "Q") is None and Framework.from_dict(fw.to_dict()) == fw and fw.dimensions[1].label("zh") == "eng"
    bare = Framework.from_dict({"id": "x", "dimensions": [{"id": "a", "short": "A"}]})
    assert bare.codes == ("A",) and bare.split_code("A") == ("a", None)
    assert len(validate({"id": "X", "dimensions": [{"id": "unassigned", "short": "a"}], "polarity": {"values": ["P"]}})) >= 4
    with pytest.raises(FrameworkError):
        Framework.from_dict({})


def test_windows():
    lines = [f"turn {i} " + "x" * 890 for i in range(24)]
    text = "\n".join(lines)
    w = plan_windows(text)
    assert all(text[x["char_start"] : x["char_end"]] == x["text"] for x in w)
    assert all(any(ln in x["text"] for x in w) for ln in lines)
    for a, b in zip(w, w[1:]):
        assert b["overlap_text"] and a["text"].endswith(b["overlap_text"]) and b["text"].startswith(b["overlap_text"])
    assert plan_windows(None) == [] and plan_windows("  ") == [] and len(plan_windows("short")) == 1
    long_line = ("A sentence of words. " * 500).strip()
    assert all(len(x["text"]) <= 3000 for x in plan_windows(long_line))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .。\n", max_size=120), max_size=30), st.integers(40, 200), st.integers(0, 30))
def test_windows_cover(lines, window, overlap):
    text = "\n".join(lines)
    w = plan_windows(text, window, overlap)
    covered = set().union(*(range(x["char_start"], x["char_end"]) for x in w)) if w else set()
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(a["char_start"] < b["char_start"] for a, b in zip(w, w[1:]))


def test_turns(spark):
    t = "Header line\n[Interviewer] How did this begin for all of you?\n[Respondent] It began with a long letter.\nAnd it went on for years after that."
    got = split_turns(t)
    assert [r for _, r, _ in got] == ["interviewer", "respondent", "respondent"]
    meet = "Speaker 3\n0:01\nGood morning to all of you here today.\nSpeaker 1\n0:10\nThank you, I have worked here for ten years and more.\nSpeaker 1\nAnd I will go on working here as long as I can do it.\nSpeaker 2\nThat is quite a while for anyone."
    df = turns(spark.createDataFrame([(1, meet), (2, None), (3, "")], "doc_id int, text string"), ["doc_id"])
    s = speakers(df, ["doc_id"])
    assert {r.speaker: r.units for r in s.collect()} == {"Speaker 3": 1, "Speaker 1": 2, "Speaker 2": 1}
    assert {r.speaker for r in suggest_interviewers(s, ["doc_id"]).collect()} == {"Speaker 2", "Speaker 3"}
    assert [r for _, r, _ in split_turns("Q: What was it like then?\nA: It was quiet in the beginning.\nQ: And then what happened?\nA: Then it was not quiet at all.")] == ["interviewer", "respondent"] * 2


def seg(q, *codes, **k):
    return {"quote": q, "full_text": k.get("full", q), "codes": [{"dimension": c, "polarity": None, "rationale": ""} for c in codes]}


def test_merge_windows():
    m = coding.merge_windows([[seg("The same long quote here", "a")], [seg("the same, long quote here!", "b")]], ["", "The same long quote here"])
    assert len(m) == 1 and {c["dimension"] for c in m[0]["codes"]} == {"a", "b"} and m[0]["history"][0]["action"] == cooccur.MERGE_ACTION
    assert len(coding.merge_windows([[seg("The same long quote here", "a")], [], [seg("The same long quote here", "a")]])) == 2
    assert len(coding.merge_windows([[seg("short")], [seg("a short one")]])) == 2
    grown = coding.merge_windows([[seg("a contained passage")], [seg("with a contained passage in it")]])
    assert len(grown) == 1 and grown[0]["quote"] == "with a contained passage in it" and grown[0]["segment_id"] == "S001"
    assert coding.merge_windows([[seg("")], None]) == []


def test_code_transcripts(spark):
    def coder(text, chunk):
        if "fail" in text:
            raise ValueError("no")
        return [{"title": "t", "quote": text[:30], "full_text": text[:40], "codes": [{"dimension": "a", "polarity": None, "rationale": ""}]}]

    docs = spark.createDataFrame([(1, "one text of some length to code"), (2, "this will fail"), (3, None)], "doc_id int, text string")
    w = coding.code_windows(docs, "doc_id", coder).collect()
    assert len(w) == 2 and sum(r.error is not None for r in w) == 1
    out = coding.code_transcripts(docs, "doc_id", coder).collect()
    assert len(out) == 1 and out[0].segment_id == "S001" and out[0].doc_id == 1


def test_yield(spark):
    docs = spark.createDataFrame([(1, "x" * 46730), (2, "y" * 21569), (3, None)], "k int, text string")
    rows = [(1, [d]) for d in "abcd"] + [(2, ["a", "b", "c", "d"][i % 4 : i % 4 + 1]) for i in range(30)]
    y = {r.k: r for r in coding.yield_report(docs, spark.createDataFrame(rows, "k int, dimensions array<string>"), "k", list("abcd")).collect()}
    assert y[1].flags == "low_yield/one_per_dimension" and y[2].flags == "" and y[3].segments == 0 and y[3].per_10k is None


def test_names_and_descriptors(spark):
    n = spark.createDataFrame([(1, "B", 0), (1, "A", 1), (1, "unknown", 2), (1, "unknown", 3), (2, "", 0)], "k int, name string, ord int")
    assert sorted((r.k, r.name) for r in coding.merge_respondent(n, ["k"]).collect()) == [(1, "B"), (2, "unknown")]
    p = spark.createDataFrame([(1, "s", "unspecified", 0), (1, "s", "x", 2), (1, "s", "y", 1), (1, "t", None, 0)], "k int, descriptor string, value string, ord int")
    assert {(r.descriptor, r.value) for r in coding.merge_descriptors(p, ["k"]).collect()} == {("s", "y"), ("t", "unspecified")}


T0 = dt.datetime(2024, 1, 1)


def ev(seg, minute, action, codes=None, text=None):
    return (1, seg, T0 + dt.timedelta(minutes=minute), minute, action, codes, text, "r")


def test_review_fold(spark):
    e = [
        ev("S1", 0, "create", ["REF-N"], "t"), ev("S1", 1, "confirm"), ev("S2", 0, "create", ["RES-P"], "t"), ev("S2", 1, "update_codes", ["RES-N"]), ev("S3", 0, "create", ["ENG-N"], "t"), ev("S3", 1, "update_codes", ["ENG-P"]),
        ev("S3", 2, "update_codes", ["ENG-N"]), ev("S4", 0, "create", ["ANT-P"], "t"), ev("S4", 1, "update_text", None, "u"), ev("S4", 2, "delete"), ev("S4", 3, "restore"), ev("S5", 0, "add", ["ANT-P"], "t"), ev("S5", 1, "update_codes", ["ANT-N"]),
        ev("S6", 0, "create", None, None), ev("S6", 1, "delete"), ev("S7", 1, "confirm")]
    df = spark.createDataFrame(e, review.EVENT_SCHEMA)
    got = {r.segment_id: r.status for r in review.replay(df).collect()}
    assert got == {"S1": "confirmed", "S2": "modified", "S3": "confirmed", "S4": "modified", "S5": "added", "S6": "deleted"}
    assert {r.segment_id: r.status for r in review.replay(df.repartition(7)).collect()} == got
    assert review.replay(df.limit(0)).count() == 0


def test_review_stream(spark, tmp_path):
    from codeloom.streaming.review import action_counts, live_state

    e = [ev("S1", 0, "create", ["REF-N"], "t"), ev("S1", 1, "update_codes", ["RES-N"]), ev("S2", 0, "create", ["ANT-P"], "t"), ev("S2", 5, "confirm")]
    spark.createDataFrame(e, review.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(review.EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    q = live_state(stream).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.segment_id: r.status for r in spark.table("live").collect()} == {"S1": "modified", "S2": "confirmed"}
    assert {r.action: r.n for r in action_counts(spark.read.parquet(str(tmp_path / "in"))).collect()} == {"create": 2, "update_codes": 1, "confirm": 1}


def test_discover_cjk(spark):
    texts = ["大數據分析很難，小數據分析也難。", "他談數據分析的人。", "我做數據分析！", "數據分析是好的", "問數據分析嗎", "用數據分析來看"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term: r for r in lexicon.discover_terms_cjk(df, least=3, pmi=0.5, entropy=0.5).collect()}
    import re

    runs = [r for t in texts for r in re.findall(r"[一-鿿]+", t)]
    cnt = Counter(r[i : i + n] for r in runs for n in range(1, 7) for i in range(len(r) - n + 1))
    total = sum(v for k, v in cnt.items() if len(k) == 1)

    def entropy(k, side):
        c = Counter()
        for r in runs:
            for i in range(len(r) - len(k) + 1):
                if r[i : i + len(k)] == k:
                    j = i - 1 if side == 0 else i + len(k)
                    c[r[j] if 0 <= j < len(r) else "^"] += 1
        n = sum(c.values())
        return -sum(v / n * math.log(v / n) for v in c.values())

    expect = {}
    for k, f in cnt.items():
        if len(k) > 1 and f >= 3:
            coh = min(math.log(f * total / (cnt[k[:i]] * cnt[k[i:]])) for i in range(1, len(k)))
            if coh >= 0.5 and min(entropy(k, 0), entropy(k, 1)) >= 0.5:
                expect[k] = coh + min(entropy(k, 0), entropy(k, 1)) + math.log(f)
    assert expect and {k: round(r.score, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in expect.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcd ", min_size=1, max_size=9), min_size=2, max_size=25, unique=True), st.sampled_from([0.3, 0.5, 0.8]))
def test_dice_exact(spark, labels, least):
    def grams(s):
        k = "".join(c for c in s.lower() if c.isalnum())
        return {k} if len(k) == 1 else {k[i : i + 2] for i in range(len(k) - 1)}

    expect = {(a, b) for a, b in itertools.combinations(sorted(labels), 2) if grams(a) and grams(b) and 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))) >= least}
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert {(r.label_a, r.label_b) for r in openbook.dice_pairs(df, [], least=least).collect()} == expect


def test_labels(spark):
    raw = ["[9x] Seasonal refusal", "[NEW CODE] Late consent", "NEW: Late consent", "Quiet trust — Delay instead of trust", "  Costly  repair ", "Costly repair.", "Second-hand repair。", "[3x]", "**Bold**", None]
    df = spark.createDataFrame([(x,) for x in raw], "x string").select(clean_label(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["Seasonal refusal", "Late consent", "Late consent", "Quiet trust", "Costly repair", "Costly repair", "Second-hand repair", "", "Bold", None]


def test_cluster():
    d = {("a", "b"): 0.1, ("a", "c"): 0.9, ("b", "c"): 0.9, ("c", "d"): 0.2, ("a", "d"): 0.95, ("b", "d"): 0.95}
    codes = [("a", 5), ("b", 1), ("c", 2), ("d", 1)]
    assert themes.cluster(codes, d) == [["a", "b"], ["c", "d"]] and len(themes.cluster(codes, d, k=1)) == 1 and themes.cluster([], {}) == []
    assert themes.fit_batch([10] * 100, 200) == 20


def test_dictionary_coder(spark):
    fw = Framework.from_dict({"id": "s", "dimensions": [{"id": "emi", "short": "EMI"}], "polarity": {"values": ["S", "A"]}})
    lex = lexicon.Lexicon(terms=(("emi", "S", "減碳"), ("emi", "S", "碳"), ("emi", "A", "污染")), patterns=(("p", "emi", "A", "不管.*空氣"),), negators=("沒有",), intensifiers=("非常",), pivots=("但是",), reported=("他說",))
    c = lexicon.DictionaryCoder(lex, fw)
    assert c.codes("我們減碳") == ["EMI-S"] and c.codes("我們沒有減碳") == ["EMI-A"] and c.scores("我們減碳") == {("emi", "S"): 1.0}
    assert c.scores("非常減碳")["emi", "S"] == 1.5 and c.codes("他說減碳") == [] and c.codes("減碳，污染") == [] and c.codes("不管空氣") == ["EMI-A"]
    assert c.scores("污染但是減碳") == {("emi", "A"): 0.7, ("emi", "S"): 1.5} and c.codes(None) == []
    bare = lexicon.DictionaryCoder(lexicon.Lexicon(terms=(("d", "", "word"),)), Framework.from_dict({"id": "b", "dimensions": [{"id": "d", "short": "D"}]}))
    assert bare.codes("a word here") == ["D"]


def test_marks(spark):
    t = "We met (late) in the old mill, and nobody spoke of the plan at all until the winter came."
    assert marks.locate(t, "old mill") == (21, 29, "exact") and marks.locate(t, "the  old\nmill")[2] == "blanks" and marks.locate(t, "WE MET LATE, IN THE OLD MILL")[2] == "loose"
    assert marks.locate(t, "xyz") is None and marks.locate(None, "a") is None and marks.locate(t, " ") is None
    df = spark.createDataFrame([(1, 0, 10, "A"), (1, 5, 15, "B"), (1, 20, 20, "C")], "d int, start_pos int, end_pos int, code string")
    assert [(r.start_pos, r.end_pos, r.codes) for r in marks.cut_points(df, ["d"]).orderBy("start_pos").collect()] == [(0, 5, ["A"]), (5, 10, ["A", "B"]), (10, 15, ["B"])]
    a = spark.createDataFrame([(["A"], ["A"], None, None), (["A"], ["B"], "both", None), (["A"], ["B"], None, None), (["A"], [], "custom", ["C"]), (["A"], ["B"], "neither", None)], "codes_a array<string>, codes_b array<string>, decision string, custom_codes array<string>")
    assert [r.codes for r in marks.adjudicate(a).collect()] == [["A"], ["A", "B"], None, ["C"], []]
    c = spark.createDataFrame([("see REF-N, res-p", 1), ("XREF-N", 2), (None, 3)], "x string, i int")
    assert [r.c for r in c.select(marks.parse_codes(F.col("x"), ["REF-N", "RES-P"]).alias("c")).collect()] == [["REF-N", "RES-P"], [], []]


def test_literature(spark):
    w = spark.createDataFrame([({"of": [1], "Theory": [0], "change": [2, 3]},), (None,), ({},)], "i map<string,array<int>>")
    assert [r.t for r in w.select(literature.abstract_text(F.col("i")).alias("t")).collect()] == ["Theory of change change", None, ""]
    c = spark.createDataFrame([(["A Bee"], 2020), (["A Bee", "C Dee"], 2021), (["A B", "C D", "E F", "G H"], None), ([], 1)], "a array<string>, y int")
    assert [r.c for r in c.select(literature.citation(F.col("a"), F.col("y")).alias("c")).collect()] == ["Bee (2020)", "Bee & Dee (2021)", "B et al. (n.d.)", "Unknown (1)"]
    d = spark.createDataFrame([("a", ["W1", "W9"]), ("b", ["W8"])], "dimension string, refs array<string>")
    good, bad = literature.guard_citations(d, spark.createDataFrame([("W1",), ("W2",)], "tag string"))
    assert [(r.dimension, r.refs) for r in good.collect()] == [("a", ["W1"])] and {r.ref for r in bad.collect()} == {"W8", "W9"}


def test_frame(spark):
    units = spark.createDataFrame([("U1", "A", "respondent", "We asked the people what they wanted, twice."), ("U2", "A", "respondent", "Nothing else happened there."), ("U3", "A", "interviewer", "Why did you ask?")], "unit_id string, respondent string, role string, text string")
    quotes = spark.createDataFrame([("q1", "A", "the people, what they wanted", ["ENG-P"]), ("q2", "A", "not there at all, no", ["ANT-N"]), ("q3", None, "x", None)], "quote_id string, respondent string, quote string, codes array<string>")
    f = {r.unit_id: r.stratum for r in frame.build_frame(quotes, units).collect()}
    assert f == {"U1": "ENG-P", "U2": frame.UNMARKED}
    assert {r.quote_id for r in frame.unmatched(quotes, units).collect()} == {"q2", "q3"}
    sheet = spark.createDataFrame([("U1", " v ", ""), ("UX", "v", "v")], "unit_id string, `ENG-P` string, `ANT-N` string")
    p = {r.unit_id: r.codes for r in frame.parse_sheet(sheet, ["ENG-P", "ANT-N"], units).collect()}
    assert p == {"U1": ["ENG-P"], "U2": [], "U3": []}


def test_sample(spark):
    rows = [(f"U{i}", [CODES[i % 8]] if i % 3 else []) for i in range(300)]
    df = spark.createDataFrame(rows, "unit_id string, ai_codes array<string>")
    s = {r.unit_id for r in frame.stratified_sample(df, CODES).collect()}
    again = {r.unit_id for r in frame.stratified_sample(df.repartition(9), CODES).collect()}
    assert s == again and len(s) == 100
    by = dict(rows)
    n = Counter(c for u in s for c in by[u])
    assert sum(not by[u] for u in s) == 35 and all(n[c] >= 4 for c in CODES)
    bare = frame.stratified_sample(df.withColumn("ai_codes", F.lit(None).cast("array<string>")), CODES, n=50)
    assert bare.count() == 50


def test_scalars(spark):
    r = spark.createDataFrame([("http://localhost:11434", "transcripts/Interview_A05.docx", "does not mention risk", "中文 text"), ("http://192.168.1.2/v1", "B.txt", None, "abc"), ("https://api.example.org", None, "ok", "123"), (None, None, None, None)], "u string, f string, r string, t string")
    got = r.select(host_class(F.col("u")).alias("h"), respondent_of_file(F.col("f")).alias("n"), is_absence(F.col("r")).alias("a"), script(F.col("t")).alias("s")).collect()
    assert [x.h for x in got] == ["loopback", "private", "public", "unknown"] and [x.n for x in got][:2] == ["Interview_A05", "B"] and [x.a for x in got] == [True, False, False, False]
    assert [x.s for x in got] == ["zh", "en", "unknown", "unknown"]


def test_long_edge_cases(spark):
    from tests.conftest import SF

    rec, fw = spark.read.parquet(f"{SF}/records.parquet"), spark.read.parquet(f"{SF}/frameworks.parquet")
    assert longtable.build_long(rec.limit(0), fw).count() == 0
    nulls = rec.withColumn("segments", F.lit(None).cast(rec.schema["segments"].dataType)).withColumn("extra", F.lit(1))
    assert longtable.build_long(nulls, fw).count() == 0 and longtable.coverage(longtable.first_rows(nulls), longtable.build_long(nulls, fw)).agg(F.sum("codes")).first()[0] == 0
    a = migrate.code_audit(rec, fw)
    assert a.filter("reason is null").count() > 0
    once = longtable.first_rows(rec)
    assert longtable.first_rows(once.unionByName(once)).count() == once.count()


def test_themes(spark):
    items = spark.createDataFrame([("G1", "A", "q", ["X"]), ("G2", "A", "r", ["X", "Y"]), ("G3", "B", "s", [])], "global_id string, respondent string, quote string, existing_codes array<string>")
    m = spark.createDataFrame([("T1", "G1"), ("T1", "G2"), ("T1", "G2"), ("T2", "G3"), ("T2", "G9")], "theme_id string, global_id string")
    t = {r.theme_id: (r.items, r.respondents, r.thin) for r in themes.theme_table(m, items).collect()}
    assert t == {"T1": (2, 1, True), "T2": (1, 1, True)} and themes.unassigned(m, items).count() == 0
    out = themes.induce(items, lambda batch: [{"name": "n", "member_ids": [b["global_id"] for b in batch]}], batch=2)
    assert themes.themes_json(out).count() == 2
    v = spark.createDataFrame([(1, True, 0), (1, False, 1), (2, True, 0), (3, False, 0)], "id int, conforming boolean, ord int")
    assert themes.contract_verdict(v).first().verdict == "shaky"


def test_corpus(spark):
    from codeloom.operators import corpus

    c = spark.createDataFrame([(1, 0, 50, "A"), (1, 60, 200, "B"), (1, 230, 300, "A"), (1, None, None, "C"), (2, 5, 900, "A"), (2, 10, 20, "B")], "k int, start_pos int, end_pos int, code string")
    got = [(r.k, r.seg_no, r.start_pos, r.end_pos, r.codes) for r in corpus.reference_segments(c, ["k"]).orderBy("k", "seg_no").collect()]
    assert got == [(1, 1, 0, 200, ["A", "B"]), (1, 2, 230, 300, ["A"]), (2, 1, 5, 900, ["A"]), (2, 2, 10, 20, ["B"])]
    p = spark.createDataFrame([(f"p{i % 20}", s) for i, s in enumerate("aabbc" * 10)], "person string, sector string")
    sub = corpus.sector_subset(p, ["c", "b"], n=3).collect()
    assert len({r.person for r in sub}) == len(sub) and all(sum(r.sector == s for r in sub) <= 3 for s in "abc")
    m = spark.createDataFrame([(1, 9, 12, "x", ["A"], None), (1, 0, 5, "y", ["B"], "c"), (1, 0, 3, "z", [], None)], "file_id int, start_pos int, end_pos int, text string, codes array<string>, comment string")
    assert [s.quote for s in corpus.record_from_marks(m).first().segments] == ["y", "x"]
    labels = spark.createDataFrame([("a", "en", "A"), ("a", "zh", "甲"), ("b", "en", "B")], "key string, lang string, label string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.label for r in corpus.label_lookup(keys, labels, "zh").collect()} == {"a": "甲", "b": "B", "c": "c"}
    assert [(r.key, r.lang) for r in corpus.missing_labels(labels, ["en", "zh"]).collect()] == [("b", "zh")]


def test_segmenter(spark):
    s = lexicon.Segmenter(["data analysis", "資料分析", "資料"])
    assert s.split("Our data analysis of data: 資料分析很難") == ["our", "data analysis", "of", "data", "資料分析", "很", "難"] and s.split(None) == []
    assert lexicon.Segmenter([]).split("a b 中文") == ["a", "b", "中", "文"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50), st.integers(-5, 5)), max_size=40, unique_by=lambda x: x[:2]), st.integers(1, 5))
def test_running_equals_window(spark, rows, parts):
    from pyspark.sql import Window

    from codeloom.functions.distributed import running

    df = spark.createDataFrame(rows, "k string, o int, v long")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("n", F.row_number().over(w)).withColumn("cumulative", F.sum("v").over(w)).collect()
    assert sorted(map(tuple, running(df, ["o"], ["k"], total="v", number="n", parts=parts).collect())) == sorted(map(tuple, want))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.text(alphabet="ab", max_size=16)), max_size=12), st.lists(st.tuples(st.sampled_from("xy"), st.text(alphabet="ab", max_size=30)), max_size=12))
def test_contained_is_exact(spark, inner, outer):
    i = spark.createDataFrame([(k, n, t) for n, (k, t) in enumerate(inner)], "k string, i int, t string")
    o = spark.createDataFrame([(k, n, t) for n, (k, t) in enumerate(outer)], "k string, o int, t string")
    want = {(n, m) for n, (k, t) in enumerate(inner) for m, (j, s) in enumerate(outer) if k == j and len(t) >= frame.LEAST and t in s}
    assert {(r.i, r.o) for r in frame.contained(i, o, "k").collect()} == want


def test_stream_out_of_order(spark, tmp_path):
    """A late event inside the watermark is applied in its place; one beyond it is not."""
    from codeloom.streaming.review import live_state

    def at(h, seq, action, codes=None):
        return (1, "S", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), seq, action, codes, "t", "r")

    batches = [[at(0, 0, "create", ["A"])], [at(2.0, 1, "update_codes", ["B"])], [at(1.5, 2, "update_codes", ["C"])], [at(9, 3, "confirm")], [at(0.5, 4, "update_codes", ["D"])], [at(9.1, 5, "confirm")]]
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, review.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(review.EVENT_SCHEMA).parquet(str(src))
        q = live_state(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("updated"), F.desc("events")).first()
    assert (last.codes, last.status) == (["B"], "modified") and last.events == 5
