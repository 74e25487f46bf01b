from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm.packing import fill_report, pack, pack_block


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120), st.sampled_from(["norm", "dot"]), st.integers(1, 20))
def test_block_keeps_every_limit(sizes, rule, most):
    s = np.array(sizes)
    where = pack_block(s, 100, most, 6000.0 if s.max() < 78 else 10000.0, rule=rule)
    cap = 6000 if s.max() < 78 else 10000
    for b in set(where):
        own = s[where == b]
        assert own.sum() <= 100 and len(own) <= most and (own**2).sum() <= cap


def test_pack(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 900, 3000)] + [2500, 0, 1024]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(9999, None, "x")], "doc_id int, n_tokens long, container_id string")
    limits = spark.createDataFrame([(1, 512), (2, 1024), (3, None), (4, 0)], "limit_id int, capacity_tokens int")
    p = pack(df, limits, block=700)
    rows = p.collect()
    for limit, cap in ((1, 512), (2, 1024)):
        own = [r for r in rows if r.limit_id == limit]
        bins, docs = defaultdict(int), defaultdict(list)
        for r in own:
            bins[r.container_id] += r.n_tokens
            docs[r.doc_id].append((r.start_token, r.n_tokens))
        assert max(bins.values()) <= cap
        assert {d: sum(n for _, n in v) for d, v in docs.items()} == {i: n for i, n in enumerate(sizes) if n}
        assert all(len(v) == 1 for d, v in docs.items() if sizes[d] <= cap)
        assert all(sorted(v)[i][0] == i * cap for v in docs.values() for i in range(len(v)))
    fill = {r.limit_id: r.fill for r in fill_report(p, limits).collect()}
    assert fill[2] > 0.97 and fill[1] > 0.9
    again = {(r.container_id, r.doc_id, r.part_pos) for r in pack(df.repartition(5), limits, block=700).collect()}
    assert again == {(r.container_id, r.doc_id, r.part_pos) for r in rows}
    assert pack(df.limit(0), limits).count() == 0


def test_one_key_many_rows(spark):
    df = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit(10).alias("n_tokens"))
    p = pack(df, spark.createDataFrame([(1, 100)], "limit_id int, capacity_tokens int"), block=1000)
    assert p.count() == 5000 and p.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] == 100


def test_attention_binds(spark):
    """No container of several items exceeds the attention capacity, and some would without it."""
    import numpy as np

    sizes = np.random.default_rng(3).integers(1, 1000, 4000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")
    limits = spark.createDataFrame([(1, 1000)], "limit_id int, capacity_tokens int")
    report = lambda **k: fill_report(pack(df, limits, **k), limits).first()
    bound, free = report(), report(cost_factor=1.0)
    assert bound.most_attention <= 0.8 < free.most_attention and bound.fill > 0.95 * free.fill
