"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. The total is the greatest at
which every source that has documents can reach its (renormalised) target without using a
document more than ``max_repeats`` times; each source's budget is its share of that total.
A source takes as many whole passes as its budget holds; the rest is fitted on the counts
by length: a seeded share of every length first, then a bounded-knapsack dynamic programme
over the remaining counts for the remaining tokens. Finally as many documents of every
length as planned are selected by a seeded hash.

Defined results
---------------
* Sources match if they differ only in case, outer blanks and the choice of blank, hyphen
  or underscore. Documents of other sources, of null source and without tokens are not
  drawn. Of several target rows of one source the one with the smallest share counts.
* Targets without documents (and null or non-positive ones) reach share 0; the other
  targets are renormalised. ``max_repeats`` null or below 1 counts as 1.
* Repeated rows of one document are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialise, small

MAX_SOURCES = 10_000
#: Rows of one (source, length) group that are ranked together; larger groups are split by hash.
RANK_ROWS = 20_000


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)[\s\-_]+", "_")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int = 60_000, distinct: int = 400, seed: int = 7) -> np.ndarray:
    """How many items of every length to take so that their sum is as near to ``budget`` as can be found.

    Taking the bulk evenly leaves at least ``slack`` tokens open where there are as many;
    for these the sums reachable with the remaining counts are worked out exactly (bounded
    knapsack on bit sets, over at most ``distinct`` lengths; over all where these miss the budget).
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    if budget > slack:
        take = np.floor(counts * ((budget - slack) / total)).astype(np.int64)
    open_ = int(budget - (take * lengths).sum())
    free = counts - take
    rng = np.random.default_rng(seed)
    if open_ > 2 * slack:
        # Many lengths with few items each were rounded down: take some more, in seeded order.
        for i in rng.permutation(len(lengths)):
            k = int(min(free[i], max(0, open_ - slack) // lengths[i]))
            take[i] += k
            free[i] -= k
            open_ -= k * int(lengths[i])
            if open_ <= slack:
                break
    # Taking nothing misses by ``open_``, so a sum of twice that or more is never the nearest.
    able = np.flatnonzero((free > 0) & (lengths <= 2 * open_))
    every = able
    if len(able) > distinct:
        # The shortest lengths decide how fine a sum can be; the others are a seeded choice.
        short = able[np.argsort(lengths[able], kind="stable")[: distinct // 2]]
        able = np.r_[short, rng.choice(np.setdiff1d(able, short), distinct - len(short), replace=False)]
    cap = 2 * open_
    mask = (1 << (cap + 1)) - 1
    goal, steps = _nearest(able, lengths, free, open_, cap, mask)
    if goal != open_ and len(able) < len(every):
        goal, steps = _nearest(every, lengths, free, open_, cap, mask)
    for i, part, before in reversed(steps):
        if not (before >> goal) & 1:
            take[i] += part
            goal -= part * int(lengths[i])
    return take


def _nearest(able: np.ndarray, lengths: np.ndarray, free: np.ndarray, open_: int, cap: int, mask: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The reachable sum nearest to ``open_``, and (length's index, part, sums reachable before) per step."""
    reach, steps = 1, []
    for i in able:
        size, left, k = int(lengths[i]), int(min(free[i], cap // lengths[i])), 1
        while left > 0:
            part = min(k, left)
            steps.append((i, part, reach))
            reach |= (reach << (size * part)) & mask
            left, k = left - part, k * 2
    below = (reach & ((1 << (open_ + 1)) - 1)).bit_length() - 1
    above_bits = reach >> (open_ + 1)
    above = open_ + 1 + ((above_bits & -above_bits).bit_length() - 1) if above_bits else None
    return (above if above is not None and above - open_ < open_ - below else below), steps


def plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(source, n_tokens, docs, passes, extra) from (source, n_tokens, docs) and the targets."""
    rows = (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))
        .filter("source is not null and share > 0").groupBy("source").agg(F.min_by("repeats", F.struct("share", "repeats")).alias("repeats"), F.min("share").alias("share"))
    )
    sums = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens"))
    have = rows.join(sums, "source").limit(MAX_SOURCES + 1).collect()
    if len(have) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    whole = sum(r.share for r in have) or 1.0
    if have and total_tokens is None:
        total_tokens = int(min(r.tokens * r.repeats / (r.share / whole) for r in have))
    budgets = {r.source: (min(round(total_tokens * r.share / whole), r.tokens * r.repeats), r.tokens, r.repeats) for r in have}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        budget, tokens, repeats = budgets[pdf["source"].iloc[0]]
        pdf = pdf.sort_values("n_tokens")
        passes = min(repeats, int(budget // tokens))
        extra = fit(pdf["n_tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64), int(budget - passes * tokens), seed=seed) if passes < repeats else 0
        return pdf.assign(passes=passes, extra=extra)

    known = counted.filter(F.col("source").isin(sorted(budgets)) if budgets else F.lit(False))
    # A source's rows are its different lengths, fewer than the root of twice its tokens.
    return known.groupBy("source").applyInPandas(one, "source string, n_tokens bigint, docs bigint, passes int, extra bigint")


def draw(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(source, doc_id, n_tokens, uses): how often every drawn document is used.

    ``sizes``: doc_id, source, n_tokens.
    """
    docs = materialise(sizes.filter("n_tokens > 0 and source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "n_tokens"), "sizes")
    counted = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    planned = materialise(plan(counted, targets, total_tokens, seed), "plan").filter("passes > 0 or extra > 0")
    planned = planned.withColumn("split", F.ceil(F.col("docs") / RANK_ROWS).cast("int"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    with_plan = docs.join(small(planned), ["source", "n_tokens"]).withColumn("bucket", F.pmod(F.shiftrightunsigned(order, 7), F.col("split")))
    whole = with_plan.filter("extra = 0 or extra = docs").withColumn("uses", F.col("passes") + (F.col("extra") > 0).cast("int"))
    some = with_plan.filter("extra > 0 and extra < docs")
    # How many rows lie in the buckets before: a few counts per hot group.
    counts = some.filter("split > 1").groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.sum("k").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("k")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy(order, "doc_id")))
    ranked = ranked.join(before, ["source", "n_tokens", "bucket"], "left")
    picked = ranked.withColumn("uses", F.col("passes") + ((F.coalesce("before", F.lit(0)) + F.col("rank")) <= F.col("extra")).cast("int"))
    columns = ["source", "doc_id", "n_tokens", "uses"]
    return whole.select(*columns).unionByName(picked.filter("uses > 0").select(*columns))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, tokens, documents and the greatest use."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
    wanted = targets.filter("source is not null").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    total = got.agg(F.sum("tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # ``total`` is one row.
    return (
        wanted.join(got, "source", "left").withColumn("one", F.lit(1)).join(total, "one")
        .select("source", "target_share", "max_repeats", zero("tokens"), zero("docs"), zero("most_uses"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"))
    )
