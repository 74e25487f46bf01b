"""Cross tables, case matrices, polarity balance and the chi-square guard.

All take a long table: one row per segment and distinct code, with ``respondent``, the unit
column (code, dimension or polarity) and descriptor columns. Results are long (one row per
cell); counts of cells that do not occur are absent unless ``dense``. Null units are
dropped, as in every count of units.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.framework import UNSPECIFIED
from codeloom.functions.stats import chi2_p
from codeloom.session import materialise


#: Codes of a framework for which a dense matrix is made.
MAX_CODES = 10_000


def crosstab(long: DataFrame, by: str, unit: str) -> DataFrame:
    """(by, unit, n): rows of the long table per descriptor value and unit."""
    return long.filter(F.col(unit).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("by"), F.col(unit).alias("unit")).agg(F.count("*").alias("n"))


def percent(cells: DataFrame, over: str = "by") -> DataFrame:
    """Adds ``pct``: percentage within the row (over="by") or column (over="unit")."""
    total = F.sum("n").over(Window.partitionBy(over))
    return cells.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def case_level(long: DataFrame, by: str, unit: str) -> DataFrame:
    """(by, unit, n) with one count per respondent: the most frequent unit, or 'mixed' on a tie.

    The descriptor is the respondent's smallest non-null value, so the result does not
    depend on row order; the counts add up to the number of respondents with a unit.
    """
    counts = long.filter(F.col(unit).isNotNull()).groupBy("respondent", F.col(unit).alias("u")).agg(F.count("*").alias("k"), F.min(by).alias("b"))
    best = F.max("k").over(Window.partitionBy("respondent"))
    top = counts.withColumn("best", best).withColumn("d", F.min("b").over(Window.partitionBy("respondent"))).filter("k = best")
    modal = top.groupBy("respondent").agg(F.when(F.count("*") == 1, F.min("u")).otherwise("mixed").alias("unit"), F.min("d").alias("by"))
    return modal.filter("by is not null").groupBy("by", "unit").agg(F.count("*").alias("n"))


def pivoted(cells: DataFrame, units: list[str]) -> DataFrame:
    """Wide form with one column per unit in the given order, 0 where nothing was counted."""
    return cells.groupBy("by").pivot("unit", units).agg(F.sum("n")).fillna(0, units)


def case_matrix(long: DataFrame, codes: DataFrame, by_percent: bool = False) -> DataFrame:
    """(respondent, code, n[, pct]) for every respondent and every code of the framework.

    ``codes`` (column ``code``) is the framework's code table: a few rows that are joined
    to every respondent because every cell must be there. One of more than ``MAX_CODES`` is refused.
    """
    if codes.limit(MAX_CODES + 1).count() > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    counts = long.filter("code is not null").groupBy("respondent", "code").agg(F.count("*").alias("n"))
    people = long.filter("respondent is not null").select("respondent").distinct()
    names = F.array_sort(F.collect_set("code"))
    grid = people.withColumn("one", F.lit(1)).join(F.broadcast(codes.agg(names.alias("all")).withColumn("one", F.lit(1))), "one").select("respondent", F.explode("all").alias("code"))
    out = grid.join(counts, ["respondent", "code"], "left").fillna(0, ["n"])
    if by_percent:
        out = out.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(Window.partitionBy("respondent")).cast("double")))
    return out


def polarity_balance(long: DataFrame, high: str, low: str) -> DataFrame:
    """Per respondent and dimension, and per respondent over all (dimension null): counts per pole, total, ratio, index.

    ratio = high / low (null if low is 0), index = (high - low) / total. One pass by
    grouping sets. Frameworks without two poles have no balance: call it with their two
    poles only.
    """
    h, l = F.sum((F.col("polarity") == high).cast("int")), F.sum((F.col("polarity") == low).cast("int"))  # noqa: E741
    pairs = long.filter(F.col("polarity").isin(high, low))
    both = pairs.groupingSets([[F.col("respondent"), F.col("dimension")], [F.col("respondent")]], "respondent", "dimension").agg(h.alias("high"), l.alias("low"))
    return both.withColumn("total", F.col("high") + F.col("low")).withColumn("ratio", F.try_divide(F.col("high").cast("double"), F.col("low").cast("double"))).withColumn(
        "index", F.try_divide((F.col("high") - F.col("low")).cast("double"), F.col("total").cast("double")))


def chi_square(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Guarded chi-square test of (by, unit, n), one row per value of ``keys``.

    Expected counts come from the margins; empty rows and columns do not exist in the long
    form, but empty cells do and add their expected count to the statistic. The test is
    valid if at most 20 % of the expected counts are below 5 and none is below 1; otherwise
    p is withheld (verdict sparse). Tables under 2 x 2 are too_small. 2 x 2 tables take
    Yates' correction, as does V then.
    """
    keys = keys or []
    c = cells.filter("n > 0")
    rows = c.groupBy(*keys, "by").agg(F.sum("n").cast("double").alias("r"))
    cols = c.groupBy(*keys, "unit").agg(F.sum("n").cast("double").alias("c"))
    join = [*keys]
    grid = (rows.join(cols, join) if join else rows.withColumn("one", F.lit(1)).join(cols.withColumn("one", F.lit(1)), "one").drop("one"))
    grid = grid.join(c, [*keys, "by", "unit"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*keys)
    grid = grid.withColumn("total", F.sum("n").over(w).cast("double")).withColumn("k_rows", F.size(F.collect_set("by").over(w))).withColumn("k_cols", F.size(F.collect_set("unit").over(w)))
    e = F.col("r") * F.col("c") / F.col("total")
    dof = (F.col("k_rows") - 1) * (F.col("k_cols") - 1)
    diff = F.abs(F.col("n") - e)
    yates = F.when(dof == 1, diff - F.least(diff, F.lit(0.5))).otherwise(diff)
    agg = grid.groupBy(*keys).agg(
        F.sum(yates * yates / e).alias("chi2"), F.max(dof).alias("dof"), F.max("total").alias("n"), F.min(e).alias("min_expected"),
        F.sum((e < 5).cast("int")).alias("small_cells"), F.count("*").alias("cells"), F.min(F.least("k_rows", "k_cols")).alias("k"))
    ok = (F.col("small_cells") / F.col("cells") <= 0.2) & (F.col("min_expected") >= 1)
    enough = F.col("dof") >= 1
    verdict = F.when(~enough, "too_small").when(ok, "ok").otherwise("sparse")
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("k") - 1)))
    return agg.select(*keys, F.when(enough, F.col("chi2")).alias("chi2"), "dof", F.col("n").cast("bigint").alias("n"), "min_expected", "small_cells", "cells", F.when(enough, v).alias("cramers_v"), verdict.alias("verdict"))


def with_p(tests: DataFrame) -> DataFrame:
    """Adds p, null where the test is withheld."""
    return tests.withColumn("p", F.when(F.col("verdict") == "ok", chi2_p(F.col("chi2"), F.col("dof").cast("double"))))


def test_sweep(long: DataFrame, descriptors: list[str], units: list[str], drop_unspecified: bool = True) -> DataFrame:
    """Every descriptor x unit x {segment, case} as one guarded test, from one grouped count.

    The long table is unpivoted twice and counted once instead of once per test.
    """
    text = lambda c: F.col(c).cast("string")
    one = lambda names, col: F.explode(F.array(*[F.struct(F.lit(x).alias("name"), text(x).alias("value")) for x in names])).alias(col)
    pairs = long.select("respondent", *dict.fromkeys([*descriptors, *units])).select("respondent", one(descriptors, "d"), *units).select("respondent", "d", one(units, "u"))
    pairs = pairs.select("respondent", F.col("d.name").alias("descriptor"), F.col("d.value").alias("by"), F.col("u.name").alias("unit_kind"), F.col("u.value").alias("unit")).filter("by is not null and unit is not null")
    if drop_unspecified:
        pairs = pairs.filter(F.col("by") != UNSPECIFIED)
    # Counted once and written, as is the small table of cells: both are read several times below.
    counts = materialise(pairs.groupBy("respondent", "descriptor", "by", "unit_kind", "unit").agg(F.count("*").alias("k")), "sweep")
    segment = counts.groupBy("descriptor", "unit_kind", "by", "unit").agg(F.sum("k").alias("n")).withColumn("level", F.lit("segment"))
    w = Window.partitionBy("respondent", "descriptor", "unit_kind")
    modal = counts.withColumn("best", F.max("k").over(w)).withColumn("b", F.min("by").over(w)).filter("k = best").groupBy("respondent", "descriptor", "unit_kind").agg(
        F.when(F.countDistinct("unit") == 1, F.min("unit")).otherwise("mixed").alias("unit"), F.min("b").alias("by"))
    case = modal.groupBy("descriptor", "unit_kind", "by", "unit").agg(F.count("*").alias("n")).withColumn("level", F.lit("case"))
    return chi_square(materialise(segment.unionByName(case), "cells"), ["descriptor", "unit_kind", "level"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def matches(c: Column, value: str | None) -> Column:
    return c.isNull() if value is None else c == value
