"""Co-occurrence of codes within a unit (segment or case)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.arrays import pairs_of

#: History action of a code that a merge across windows brought in.
MERGE_ACTION = "merged_across_excerpts"


def cooccurrence(long: DataFrame, unit: list[str], code: str = "code") -> DataFrame:
    """(code_a, code_b, n, jaccard) of codes that occur together in a unit, code_a < code_b.

    A code counts once per unit. Each unit's distinct codes become one array, which is as
    long as the framework has codes; its pairs, each code with itself among them, are
    exploded and pre-aggregated in one pass over the input. The totals of the codes are the
    diagonal of that small table, read by windows over it. Null codes are dropped.
    """
    sets = long.filter(F.col(code).isNotNull()).groupBy(*unit).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    diagonal = F.transform("codes", lambda c: F.struct(c.alias("code_a"), c.alias("code_b")))
    cells = sets.select(F.explode(F.concat(diagonal, pairs_of(F.col("codes"), "code_a", "code_b"))).alias("p")).groupBy("p.code_a", "p.code_b").agg(F.count("*").alias("n"))
    on_diagonal = F.when(F.col("code_a") == F.col("code_b"), F.col("n"))
    with_totals = cells.withColumn("ta", F.max(on_diagonal).over(Window.partitionBy("code_a"))).withColumn("tb", F.max(on_diagonal).over(Window.partitionBy("code_b")))
    return with_totals.filter("code_a <> code_b").select("code_a", "code_b", "n", (F.col("n") / (F.col("ta") + F.col("tb") - F.col("n"))).alias("jaccard"))


def totals(long: DataFrame, unit: list[str], code: str = "code") -> DataFrame:
    """(code, n): units in which each code occurs (the diagonal)."""
    return long.filter(F.col(code).isNotNull()).select(*unit, code).distinct().groupBy(code).agg(F.count("*").alias("n"))


def dense(pairs: DataFrame, diagonal: DataFrame, codes: DataFrame) -> DataFrame:
    """Full matrix (code_a, code_b, n) over the framework's codes, 0 where nothing occurs."""
    names = codes.agg(F.array_sort(F.collect_set("code")).alias("all"))
    grid = names.select(F.explode("all").alias("code_a"), "all").select("code_a", F.explode("all").alias("code_b"))
    both = pairs.select("code_a", "code_b", "n").unionByName(pairs.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "n"))
    both = both.unionByName(diagonal.select(F.col("code").alias("code_a"), F.col("code").alias("code_b"), "n"))
    return grid.join(both, ["code_a", "code_b"], "left").fillna(0, ["n"])


def top_pairs(pairs: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent pairs (ties: Jaccard, then names), and whether they cross dimensions."""
    first = lambda c: F.split(F.col(c), "-")[0]
    crossing = first("code_a") != first("code_b")
    return pairs.withColumn("cross_dimension", crossing).orderBy(F.desc("n"), F.desc("jaccard"), "code_a", "code_b").limit(n)


def merged_codes(segments: DataFrame) -> DataFrame:
    """``segments`` (review, codes as strings in ``code_list``) with ``merged``: codes that a window merge added."""
    details = F.transform(F.filter(F.coalesce("review.history", F.array().cast("array<struct<time:string,action:string,detail:string,reviewer:string>>")), lambda h: h["action"] == MERGE_ACTION), lambda h: F.split(F.regexp_replace(h["detail"], r"^.*:\s*", ""), r"\s*,\s*"))
    return segments.withColumn("merged", F.array_sort(F.array_intersect(F.flatten(details), F.col("code_list"))))
