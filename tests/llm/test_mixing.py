from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import mixing
from codeloom.llm.tokens import count_tokens, encoder

TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 400))
def test_fit_is_the_best_sum(hist, budget):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    take = mixing.fit(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    sums = {0}
    for n, c in hist.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_large():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(20, 9000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = mixing.fit(lengths, counts, budget)
    assert int((take * lengths).sum()) == budget and (take <= counts).all()


def test_draw(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "Web-Text" if i % 3 else " web_text", int(n)) for i, n in enumerate(rng.integers(5, 400, 2000))] + [(5000 + i, "book", int(n)) for i, n in enumerate(rng.integers(50, 900, 60))]
    rows += [(9000, "other", 50), (9001, None, 50), (9002, "book", 0)]
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, source string, n_tokens long, uses string")
    targets = spark.createDataFrame([("web_text", 0.6, 1), ("book", 0.3, 3), ("none", 0.1, 2)], TARGETS)
    d = mixing.draw(sizes, targets)
    got = {r.source: r for r in mixing.shares(d, targets).collect()}
    assert abs(got["web_text"].reached_share - 2 / 3) < 1e-3 and abs(got["book"].reached_share - 1 / 3) < 1e-3 and got["none"].reached_share == 0
    assert got["book"].most_uses <= 3 and got["web_text"].most_uses == 1
    assert d.groupBy("doc_id").count().filter("count > 1").count() == 0 and d.filter("source not in ('web_text', 'book')").count() == 0
    assert {(r.doc_id, r.uses) for r in mixing.draw(sizes.repartition(7), targets).collect()} == {(r.doc_id, r.uses) for r in d.collect()}


def test_hot_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 100)
    sizes = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.lit(7).cast("bigint").alias("n_tokens"))
    d = mixing.draw(sizes, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    assert {r.source: (r["sum"], r.n) for r in d.groupBy("source").agg(F.sum("uses").alias("sum"), F.countDistinct("doc_id").alias("n")).collect()} == {"a": (1000, 1000), "b": (1000, 1000)}


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id int, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, None)], TARGETS)
    d = mixing.draw(sizes, targets)
    assert d.count() == 0 and mixing.shares(d, targets).first().reached_share == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()}
    assert got[1] == len(encoder().encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] >= 5000


def test_fit_reads_all_lengths_when_the_chosen_miss():
    """Only the greatest length is odd, and an odd budget needs it whatever 8 lengths are chosen."""
    for seed in range(6):
        lengths = np.r_[np.arange(2, 122, 2), 1001]
        counts = np.ones(len(lengths), np.int64)
        take = mixing.fit(lengths, counts, 1301, distinct=8, seed=seed)
        assert int((take * lengths).sum()) == 1301 and (take <= counts).all()
