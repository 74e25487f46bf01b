from __future__ import annotations

import random

import numpy as np
import pytest

from codeloom.llm import abuse

OBJECTS = ["plan", "map", "desk", "list", "meter", "notice", "roster", "survey", "form", "record"]
#: The last two templates of each kind are held out: only their words were met in training.
CLEAN = ["They checked the {} at noon.", "Nobody asked about the {}.", "The {} was late again.", "We read the word idiot on the {} and reported it.", "They asked about the {} again.", "The {} was checked at noon."]
BAD = [("insult", "You {} idiot, go away."), ("insult", "What a {} moron you are."), ("threat", "I will break your legs at the {}."), ("insult", "Shut up, you 1d10t of the {}."), ("insult", "Go away, you moron of the {}."), ("threat", "I will break you at the {}.")]


def corpus(n=700, seed=2, held=False):
    rng = random.Random(seed)
    clean, bad = (CLEAN[4:], BAD[4:]) if held else (CLEAN[:4], BAD[:4])
    out = []
    for _ in range(n):
        ss = [rng.choice(clean).format(rng.choice(OBJECTS)) for _ in range(rng.randint(1, 6))]
        abusive, kind = rng.random() < 0.3, None
        if abusive:
            kind, t = rng.choice(bad)
            ss.insert(rng.randint(0, len(ss)), t.format(rng.choice(OBJECTS)))
        verdict = abusive if rng.random() > 0.05 else not abusive
        out.append((" ".join(ss), abusive, verdict, kind or "insult"))
    return out


@pytest.fixture(scope="module")
def model():
    return abuse.train([(t, 0.9 if v else 0.02, k) for t, _, v, k in corpus()], max_clean=2000)


def score(m, text):
    return float(m.score_texts([text])[0])


def test_held_out_templates(model):
    docs = corpus(300, 5)
    got = model.score_texts([t for t, *_ in docs]) >= abuse.ABUSIVE
    assert np.mean(got == np.array([a for _, a, *_ in docs])) > 0.97
    docs = corpus(300, 5, held=True)
    s, a = model.score_texts([t for t, *_ in docs]), np.array([a for _, a, *_ in docs])
    assert np.mean(s[a][:, None] > s[~a][None, :]) > 0.95
    assert score(model, "You map id10t, go away.") > score(model, "They checked the map at noon.")


def test_fold():
    assert abuse.fold("D.i.c.k is 5h1t") == "dick is shit" and abuse.fold("i d i o ts!") == "idiots!" and abuse.fold("Nеvеr") == "never" and abuse.fold("王．八 蛋") == "王八蛋"
    assert abuse.fold("The U.S. rule 3a, i.e. p.m.") == "the u.s. rule 3a, i.e. p.m." and abuse.fold("") == ""


def test_rows_of_a_line():
    w = abuse.Words(1 << 12)
    a, b, c, empty = w.bags(["red red", "red", "王八蛋", ""])
    assert len(a) == 2 * len(b) + 1 and set(b) < set(a) and len(empty) == 0
    assert len(c) == 3 + 2 + 1
    ids, where = w.tokens(["red 12 95", "", "王 red"])
    assert list(where) == [0, 0, 0, 2, 2] and ids[1] == ids[2]


def test_probabilities():
    p = abuse.probabilities({(0, 1): 600, (1, 1): 100, (0, 2): 500, (1, 2): 80, (2, 2): 80})
    assert p[0, 1] < 0.1 < p[1, 2] < p[1, 1] < p[2, 2] and p[2, 2] > 0.9
    assert abuse.probabilities({}) == {}


def test_gradient():
    """One step by the count matrix equals the step written out, repeated rows included."""
    bags, y = [np.array([1, 1, 2], np.int32), np.array([2, 3], np.int32)], np.array([1, 0])
    words = abuse.Words(8)
    m = abuse._fit(bags, y, np.ones(2, np.float32), words, 2, 4, 1, 0.5, 3)
    rng = np.random.default_rng(3)
    v = rng.uniform(-1 / 4, 1 / 4, (8, 4)).astype(np.float32)
    order = rng.permutation(2)
    W, b, old = np.zeros((4, 2)), np.zeros(2), v.copy()
    for i in order:
        h = old[bags[i]].mean(0)
        g = np.full(2, 0.5)
        g[y[i]] -= 1
        W -= 0.5 * np.outer(h, g)
        b -= 0.05 * g
    # The softmax starts at 0, so the first step leaves the vectors as they are.
    assert np.allclose(m.logits[:, 0], old @ (W[:, 1] - W[:, 0]), atol=1e-6) and np.isclose(m.bias[0], b[1] - b[0])


def test_operator(spark):
    docs = [(i, t, "s", v, k) for i, (t, _, v, k) in enumerate(corpus(300))]
    df = spark.createDataFrame([(i, t, s) for i, t, s, *_ in docs] + [(9000, None, None), (9001, "", "s"), (9002, "123", "s")], "doc_id long, text string, source string")
    reviews = spark.createDataFrame([(2 * i + n, i, f"r{n}", k if v else "none", 1) for i, _, _, v, k in docs for n in (0, 1)] + [(8000, 1, "q", None, 1)], "review_id long, doc_id long, rater string, verdict string, reviewed_at int")
    got = {r.doc_id: r.abuse_score for r in abuse.score_documents(df, reviews, max_clean=1000).collect()}
    assert len(got) == len(docs) + 3 and got[9000] == got[9001] == got[9002] == 0 and all(0 <= v <= 1 for v in got.values())
    for few in (reviews.filter("verdict = 'none'"), reviews.limit(0), reviews.filter("verdict <> 'none'"), reviews.filter("doc_id < 12")):
        none = abuse.score_documents(df, few)
        assert none.filter("abuse_score is not null").count() == 0 and none.count() == len(got)
    assert len(abuse.reviewed_documents(df, reviews, 20, 10**6)) <= 20 and sum(len(t) for t, *_ in abuse.reviewed_documents(df, reviews, 6000, 500)) <= 500


def test_labels_and_long_pieces(model):
    assert score(model, "[You map idiot, go away]") >= abuse.ABUSIVE and score(model, "They met. (What a moron you are)") >= abuse.ABUSIVE
    assert score(model, "Idiots_and_moron: at noon.") > score(model, "at noon.")
    assert list(abuse.pieces("[Laughs] Well.\nA: No.")) == ["Well.", "No."] and "你這白痴：走開" in abuse.pieces("你這白痴：走開", labelled=True)
    long = "x" * 5000 + " y"
    assert "".join(dict.fromkeys(p[:1000] for p in abuse.pieces(long))).startswith("x") and list(abuse.pieces(long))[-1].endswith(" y")
    assert list(abuse.pieces(None)) == []
