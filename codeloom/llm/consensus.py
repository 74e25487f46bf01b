"""Consensus from several annotators' labels by iteratively reweighted voting.

Each round alternates two steps until the weights settle: (1) every label of a unit gets
the summed weights of the annotators who chose it; (2) every annotator's accuracy is
re-estimated leaving out their own vote, smoothed towards the overall mean, and turned
into a vote weight log(accuracy * (K - 1) / (1 - accuracy)), never below 0. Votes are
pre-aggregated per (unit, label) before they are shuffled, so a unit or an annotator with
a third of all rows stays spread; only the weights (one row per annotator) are joined
back, broadcast if they are few. The weights are written to the shared folder after every
round, which cuts the lineage.

Agreement is Krippendorff's alpha for nominal label sets with missing ratings.

Defined results
---------------
* Annotators are the same if names differ only in case or outer blanks; a null name
  counts as ''. Of several judgements of a unit by one annotator the latest counts (ties:
  the one received last, then the greatest label list).
* Null or empty label lists say that no label applies. Null labels are dropped.
* Units with fewer than ``min_annotators`` annotators get no consensus but count for the
  annotators' accuracy from two annotators on.
* Ties go to "nothing applies", then to the smaller label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialise, small

#: Separates a label's first part (decided first) from its second part.
SEP = "\x1f"
NOTHING = ""


@dataclass(frozen=True)
class Consensus:
    """``labels`` (unit_id, label, support), ``annotators`` (coder, n, accuracy, weight), ``rounds``, and whether the weights had settled."""

    labels: DataFrame
    annotators: DataFrame
    judgements: DataFrame
    rounds: int
    stable: bool


def latest_judgements(rows: DataFrame) -> DataFrame:
    """(unit_id, coder, labels) from (unit_id, coder, labels, coded_at, received_at); see the module."""
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return (
        rows.filter(F.col("unit_id").isNotNull())
        .select("unit_id", F.lower(F.trim(F.coalesce("coder", F.lit("")))).alias("coder"), F.struct("coded_at", "received_at", clean.alias("labels")).alias("j"))
        .groupBy("unit_id", "coder").agg(F.max("j").alias("j"))
        .select("unit_id", "coder", "j.labels")
    )


def _unit_scores(judgements: DataFrame, weights: DataFrame) -> DataFrame:
    """(unit_id, scores): summed weights per label. The list is as long as the unit has different labels."""
    votes = judgements.select("unit_id", "coder", F.explode(F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(NOTHING)))).alias("label"))
    return (
        votes.join(weights, "coder")
        .groupBy("unit_id", "label").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
        .groupBy("unit_id").agg(F.collect_list(F.struct("label", "s", "n")).alias("scores"))
    )


def _hits(judgements: DataFrame, weights: DataFrame) -> DataFrame:
    """(coder, n, hit): judgements that could be checked against the others, and how many agreed."""
    own = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(NOTHING)))
    rest = F.transform("scores", lambda x: F.struct(
        (x["s"] - F.when(F.array_contains(own, x["label"]), F.col("weight")).otherwise(0.0)).alias("s"),
        (x["n"] - F.array_contains(own, x["label"]).cast("int")).alias("n"), x["label"].alias("label")))
    best = F.array_max(F.filter(rest, lambda x: x["n"] > 0))
    return (
        judgements.join(_unit_scores(judgements, weights), "unit_id").join(weights, "coder")
        .select("coder", best.alias("best"), own.alias("own"))
        .filter("best is not null")
        .groupBy("coder").agg(F.count("*").alias("n"), F.sum(F.array_contains("own", F.col("best.label")).cast("int")).alias("hit"))
    )


def reach_consensus(
    rows: DataFrame, min_annotators: int = 3, classes: int = 6, smoothing: float = 4.0, max_weight: float = 4.0,
    share: float = 0.5, max_rounds: int = 25, tolerance: float = 0.02,
) -> Consensus:
    """Consensus of (unit_id, coder, labels, coded_at, received_at).

    ``classes`` is K of the weight, ``share`` the weighted share from which a unit gets a
    label besides its best one. The rounds end when the weights move by less than
    ``tolerance`` on average, or after ``max_rounds``, which the result then says. Labels of the form ``a SEP b`` are decided in two steps: a
    by the votes for any of its labels, then b among them.
    """
    judgements = materialise(latest_judgements(rows), "judgements")
    weights = judgements.select("coder").distinct().withColumn("weight", F.lit(1.0))
    annotators, rounds, stable = None, 0, False
    weights = materialise(weights, "weights")
    for rounds in range(1, max_rounds + 1):
        weights = small(weights)
        hits = materialise(_hits(judgements, weights), "hits")
        mean = hits.agg(F.try_divide(F.sum("hit"), F.sum("n")).alias("m")).first().m or 0.5
        accuracy = (F.coalesce("hit", F.lit(0)) + smoothing * mean) / (F.coalesce("n", F.lit(0)) + smoothing)
        weight = F.least(F.lit(max_weight), F.greatest(F.lit(0.0), F.log(accuracy * (classes - 1) / F.greatest(F.lit(1e-9), 1 - accuracy))))
        annotators = materialise(
            weights.withColumnRenamed("weight", "was").join(hits, "coder", "left")
            .select("coder", F.coalesce("n", F.lit(0)).alias("n"), accuracy.alias("accuracy"), weight.alias("weight"), "was"), "annotators")
        moved = annotators.agg(F.avg(F.abs(F.col("weight") - F.col("was"))).alias("d")).first().d
        weights = annotators.select("coder", "weight")
        stable = moved is None or moved < tolerance
        if stable:
            break
    labels = decide(judgements, small(weights), min_annotators, share)
    return Consensus(labels, annotators.drop("was"), judgements, rounds, stable)


def decide(judgements: DataFrame, weights: DataFrame, min_annotators: int, share: float) -> DataFrame:
    """(unit_id, label, support) of the units with enough annotators; support is the weighted share."""
    first = lambda x: F.split_part(x, F.lit(SEP), F.lit(1))
    parts = F.array_distinct(F.transform("labels", first))
    vote = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    votes = F.concat(
        F.array(vote(none, none)),
        F.when(F.size("labels") == 0, F.array(vote(F.lit(NOTHING), none))).otherwise(F.transform(parts, lambda p: vote(p, none))),
        F.transform("labels", lambda x: vote(first(x), x)),
    )
    # A little of the plain count decides where all weights are 0.
    scored = (
        judgements.join(weights, "coder").select("unit_id", "weight", F.explode(votes).alias("v"))
        .groupBy("unit_id", "v.a", "v.b").agg((F.sum("weight") + F.count("*") * 1e-6).alias("s"), F.count("*").alias("n"))
        .groupBy("unit_id").agg(
            F.max(F.when(F.col("a").isNull(), F.col("s"))).alias("total"), F.max(F.when(F.col("a").isNull(), F.col("n"))).alias("n"),
            F.max(F.when(F.col("a") == NOTHING, F.col("s"))).alias("nothing"),
            F.collect_list(F.when((F.col("a") != NOTHING) & F.col("b").isNull(), F.struct((-F.col("s")).alias("s"), F.col("a").alias("a")))).alias("firsts"),
            F.collect_list(F.when(F.col("b").isNotNull(), F.struct((-F.col("s")).alias("s"), F.col("b").alias("b"), F.col("a").alias("a")))).alias("fulls"))
        .filter(F.col("n") >= min_annotators)
        .withColumn("firsts", F.array_sort("firsts"))
        .filter((F.size("firsts") > 0) & (-F.try_element_at("firsts", F.lit(1))["s"] > F.coalesce("nothing", F.lit(0.0))))
    )
    kept = F.filter("firsts", lambda x, i: (i == 0) | (-x["s"] >= share * F.col("total")))
    best = lambda a: F.array_min(F.filter("fulls", lambda y: y["a"] == a))["b"]
    chosen = F.transform(kept, lambda x: F.struct(best(x["a"]).alias("label"), (-x["s"] / F.col("total")).alias("support")))
    return scored.select("unit_id", F.explode(chosen).alias("c")).select("unit_id", "c.label", "c.support")


def alpha_of_sets(judgements: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha (nominal, missing ratings) over whole label sets, with its counts.

    From the counts n_uc of each set c in unit u with m_u >= 2 judgements: observed
    disagreement sum(n_uc * (m_u - n_uc) / (m_u - 1)) / n; expected disagreement
    sum(n_c * (n - n_c)) / (n * (n - 1)). Null where nothing is pairable or only one set
    occurs.
    """
    value = F.concat_ws("\x1e", "labels")
    per = judgements.groupBy("unit_id", value.alias("v")).agg(F.count("*").alias("k"))
    units = per.groupBy("unit_id").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk")).filter("m > 1")
    observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("kk")) / (F.col("m") - 1)).alias("d"), F.sum("m").alias("n"), F.count("*").alias("units"))
    values = per.join(units.select("unit_id"), "unit_id", "left_semi").groupBy("v").agg(F.sum("k").cast("double").alias("c")).agg(F.sum("c").alias("n2"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    # Both sides are one row.
    both = observed.withColumn("one", F.lit(1)).join(values.withColumn("one", F.lit(1)), "one")
    expected = (F.col("n2") * F.col("n2") - F.col("cc")) / (F.col("n2") - 1)
    return both.select("units", F.col("n").alias("judgements"), (1 - F.try_divide("d", F.when(expected > 0, expected))).alias("alpha"))
