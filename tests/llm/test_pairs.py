from __future__ import annotations

import itertools
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from codeloom.llm.pairs import PairTable, count_pairs

SCHEMA = "scope string, basket string, items array<string>, version int, items_a string"


def brute(state):
    n, items, pairs = Counter(), Counter(), Counter()
    for scope, its in state.values():
        its = sorted({i for i in its or [] if i is not None})
        if its:
            n[scope] += 1
            items.update((scope, i) for i in its)
            pairs.update((scope, a, b) for a, b in itertools.combinations(its, 2))
    return {(s, a, b): (k, items[s, a], items[s, b], n[s]) for (s, a, b), k in pairs.items()}


def got(df):
    return {(r.scope, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in df.collect()}


batches = st.lists(st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 6), st.none() | st.lists(st.none() | st.sampled_from("abcd"), max_size=5)), max_size=8), min_size=1, max_size=3)


@settings(max_examples=6, deadline=None)
@given(batches)
def test_batches_equal_brute_force(spark, data):
    table, state, version = PairTable(spark, buckets=3), {}, 0
    for batch in data:
        rows = []
        for scope, b, items in batch:
            version += 1
            rows.append((scope, f"b{b}", items, version, "extra"))
            state[f"b{b}"] = (scope, items)
        table.apply(spark.createDataFrame(rows, SCHEMA))
        assert got(table.scores()) == brute(state)


def test_changes_and_repeats(spark):
    mk = lambda *rows: spark.createDataFrame([(s, b, i, v, "") for s, b, i, v in rows], SCHEMA)
    t = PairTable(spark, buckets=2)
    t.apply(mk(("s", "1", ["a", "b", "a"], 1), ("s", "2", ["a", "b"], 1), ("u", "3", ["a", "c"], 1)))
    assert got(t.scores()) == {("s", "a", "b"): (2, 2, 2, 2), ("u", "a", "c"): (1, 1, 1, 1)}
    assert t.apply(mk(("s", "1", ["b", "a"], 2))).count() == 0
    touched = t.apply(mk(("s", "1", None, 3), ("s", "2", ["b", "c"], 3)))
    assert {r.scope for r in touched.collect()} == {"s"} and got(t.scores(touched)) == {("s", "b", "c"): (1, 1, 1, 1)}
    assert got(count_pairs(mk(), buckets=2)) == {}


def mk(spark, *rows):
    return spark.createDataFrame([(s, b, i, v, "") for s, b, i, v in rows], SCHEMA)


def test_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = PairTable(spark, path, buckets=2)
    a.apply(mk(spark, ("s", "1", ["a", "b"], 5), ("u", "2", ["a", "c"], 5)))
    b = PairTable(spark, path)
    assert b.version == a.version and b.state["buckets"] == 2
    b.apply(mk(spark, ("s", "3", ["a", "b"], 1)))
    assert got(b.scores()) == {("s", "a", "b"): (2, 2, 2, 2), ("u", "a", "c"): (1, 1, 1, 1)}
    # The first object is behind: its next change is refused.
    with pytest.raises(Exception, match="(?i)exist"):
        a.apply(mk(spark, ("s", "9", ["a", "b"], 1)))
    c = PairTable(spark, path)
    c.vacuum()
    assert got(PairTable(spark, path).scores()) == got(b.scores())
    c.apply(mk(spark, ("s", "3", ["a", "d"], 2)))
    assert got(PairTable(spark, path).scores()) == {("s", "a", "b"): (1, 2, 1, 2), ("s", "a", "d"): (1, 2, 1, 2), ("u", "a", "c"): (1, 1, 1, 1)}


def test_late_older_row(spark):
    t = PairTable(spark, buckets=2)
    t.apply(mk(spark, ("s", "1", ["a", "b"], 2)))
    assert t.apply(mk(spark, ("s", "1", ["x", "y"], 1))).count() == 0
    t.apply(mk(spark, ("s", "1", ["a", "b"], 4)))
    t.apply(mk(spark, ("s", "1", ["x", "y"], 3), ("s", "1", ["p", "q"], None)))
    assert got(t.scores()) == {("s", "a", "b"): (1, 1, 1, 1)}


def test_owner_withdraws(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "owner string, scope string, basket string, items array<string>, version int")
    t = PairTable(spark, buckets=2)
    t.apply(rows(("r", "s", "r0", ["a", "b"], 1), ("r", "s", "r1", ["a", "c"], 1), ("r", "s", "r1", ["a", "c"], 1), ("q", "s", "q0", ["a", "b"], 1)))
    assert got(t.scores())[("s", "a", "b")] == (2, 3, 2, 3)
    t.apply(rows(("r", "s", "r0", ["a", "b"], 2), ("r", "s", "r2", None, 2)))
    assert got(t.scores()) == {("s", "a", "b"): (2, 2, 2, 2)}
    t.apply(rows(("r", None, "r-1", None, 3), ("q", "s", "q0", [None], 2)))
    assert got(t.scores()) == {}


def test_only_touched_scopes_and_large_basket(spark):
    t = PairTable(spark, buckets=4)
    many = [f"i{k:04d}" for k in range(600)]
    t.apply(mk(spark, ("big", "1", many, 1), ("u", "2", ["a", "c"], 1)))
    assert t.scores().filter("scope = 'big'").count() == 600 * 599 // 2
    t.apply(mk(spark, ("u", "3", ["a", "c"], 1)))
    s = t.scores()
    assert s.filter("scope = 'big'").count() == 600 * 599 // 2 and got(s.filter("scope = 'u'")) == {("u", "a", "c"): (2, 2, 2, 2)}


def test_label_baskets_withdraw(spark):
    from codeloom.llm.baskets import label_baskets

    code = "array<struct<code_id:string,label:string>>"
    o = spark.createDataFrame(
        [(1, ("c",), [{"open_codes": [("1", "X"), ("2", "Y")]}], 1, 1), (1, ("c",), [{"open_codes": [("1", "gone")]}], 2, 2), (2, ("c",), [{"open_codes": [("1", "X"), (None, "new: y.")]}], 1, 1), (2, ("c",), None, 0, 9)],
        f"record_id int, _meta struct<codebook_id:string>, open_segments array<struct<open_codes:{code}>>, saved_at int, received_at int")
    book = spark.createDataFrame([("c", [("X",), ("Y",)])], "codebook_id string, codes array<struct<label:string>>")
    assert got(count_pairs(label_baskets(o, book), [F.col("received_at") < 2], buckets=2)) == {("c", "X", "Y"): (1, 1, 1, 1)}
