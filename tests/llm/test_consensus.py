from __future__ import annotations

import random

from codeloom.llm.consensus import SEP, alpha_of_sets, latest_judgements, reach_consensus

SCHEMA = "unit_id string, coder string, labels array<string>, coded_at int, received_at int, remark string"


def test_latest(spark):
    rows = [("u", " Ann ", ["a"], 1, 1, ""), ("u", "ann", ["b", None, "b"], 2, 0, ""), ("u", None, None, 1, 1, ""), (None, "x", ["a"], 1, 1, "")]
    got = {(r.unit_id, r.coder): r.labels for r in latest_judgements(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("u", "ann"): ["b"], ("u", ""): []}


def simulate(n=400, seed=5):
    rng = random.Random(seed)
    dims = [f"d{i}" for i in range(4)]
    skill = {f"c{i}": q for i, q in enumerate([0.95, 0.9, 0.9, 0.6, 0.5, 0.1, 0.1])}
    truth, rows = {}, []
    for u in range(n):
        t = [] if rng.random() < 0.15 else [rng.choice(dims) + SEP + rng.choice("PN")]
        truth[f"u{u}"] = t
        for c in rng.sample(sorted(skill), 5):
            lab = t if rng.random() < skill[c] else ([] if rng.random() < 0.2 else [rng.choice(dims) + SEP + rng.choice("PN")])
            rows.append((f"u{u}", c, lab, 1, 1, ""))
    return truth, rows


def test_beats_majority(spark):
    truth, rows = simulate()
    c = reach_consensus(spark.createDataFrame(rows, SCHEMA))
    got: dict = {}
    for r in c.labels.collect():
        got.setdefault(r.unit_id, []).append(r.label)
    right = sum(sorted(got.get(u, [])) == t for u, t in truth.items()) / len(truth)
    acc = {r.coder: r.accuracy for r in c.annotators.collect()}
    assert right > 0.93 and acc["c0"] > acc["c3"] > acc["c5"]


def test_edges(spark):
    few = [("u", "a", ["x"], 1, 1, ""), ("u", "b", ["x"], 1, 1, "")]
    assert reach_consensus(spark.createDataFrame(few, SCHEMA)).labels.count() == 0
    assert reach_consensus(spark.createDataFrame([], SCHEMA)).labels.count() == 0
    tie = [("u", "a", ["x"], 1, 1, ""), ("u", "b", [], 1, 1, ""), ("u", "c", ["y"], 1, 1, ""), ("u", "d", None, 1, 1, "")]
    assert reach_consensus(spark.createDataFrame(tie, SCHEMA)).labels.count() == 0
    same = [("u", c, ["x", "y"], 1, 1, "") for c in "abc"]
    assert {r.label for r in reach_consensus(spark.createDataFrame(same, SCHEMA)).labels.collect()} == {"x", "y"}


def test_alpha(spark):
    a, b = [1, 2, 3, 3, 2, 1, 4, 1, 2], [1, 2, 3, 3, 2, 2, 4, 1, 2]
    rows = [(str(i), c, [str(v)], 1, 1, "") for c, col in (("a", a), ("b", b)) for i, v in enumerate(col)]
    assert round(alpha_of_sets(latest_judgements(spark.createDataFrame(rows, SCHEMA))).first().alpha, 3) == 0.852
