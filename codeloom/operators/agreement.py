"""Agreement between coders: binary family, pooled and per code, alpha, confusion, disagreement.

Codings are long: (unit_id, coder, codes array<string>); the codes of a unit are a set.
Null lists count as empty. Results are null where undefined. ``keys`` (framework, coder)
group a table that holds several pairs of coders; ``codes`` is then a column of each row's codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.arrays import sorted_set
from codeloom.functions.stats import agreement_columns, is_paradox, kappa_band


def _flag(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def binary_agreement(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Agreement of two 0/1 columns ``a`` and ``b``, over all rows or per key. Null counts as 0."""
    a, b = (F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1 for c in ("a", "b"))
    counts = pairs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), _flag(a & b).alias("both_yes"), _flag(~a & ~b).alias("neither"), _flag(a & ~b).alias("only_a"), _flag(~a & b).alias("only_b"))
    extra = agreement_columns(*(F.col(c) for c in ("n", "both_yes", "neither", "only_a", "only_b")))
    return counts.select("*", *(c.alias(k) for k, c in extra.items()))


def with_bands(agreement: DataFrame) -> DataFrame:
    """Adds the words for kappa and the paradox flag."""
    return agreement.withColumn("band", kappa_band(F.col("kappa"))).withColumn("paradox", is_paradox(F.col("kappa"), F.col("pabak"), F.col("prevalence")))


def align(codings: DataFrame, coder_a: str, coder_b: str) -> DataFrame:
    """(unit_id, codes_a, codes_b) of the units that both coders judged."""
    own = lambda name, col: codings.filter(F.col("coder") == name).groupBy("unit_id").agg(sorted_set(F.flatten(F.collect_list("codes"))).alias(col))
    return own(coder_a, "codes_a").join(own(coder_b, "codes_b"), "unit_id")


def unit_codes(aligned: DataFrame, codes: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, unit_id, code, a, b) for every unit and every code of the framework: a flat map, no cross join."""
    wanted = codes if isinstance(codes, Column) else F.array(*map(F.lit, codes))
    cells = F.transform(wanted, lambda c: F.struct(c.alias("code"), F.array_contains("codes_a", c).alias("a"), F.array_contains("codes_b", c).alias("b")))
    return aligned.select(*keys, "unit_id", F.explode(cells).alias("x")).select(*keys, "unit_id", "x.*")


def per_code(aligned: DataFrame, codes: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement per code."""
    return binary_agreement(unit_codes(aligned, codes, keys), [*keys, "code"])


def pooled(aligned: DataFrame, codes: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement over all unit x code cells."""
    return binary_agreement(unit_codes(aligned, codes, keys), list(keys))


def pooled_alpha(aligned: DataFrame, codes: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Krippendorff's alpha (nominal, two coders) over all unit x code cells, per ``keys``: (keys, pairable, alpha).

    From the four counts alone: with two ratings a cell, n the ratings and n1 those that
    say yes, alpha = 1 - (n - 1) * disagreements / (n1 * (n - n1)). Null where all ratings are equal.
    """
    counts = pooled(aligned, codes, keys)
    n, yes = 2.0 * F.col("n"), 2.0 * F.col("both_yes") + F.col("only_a") + F.col("only_b")
    expected = yes * (n - yes)
    alpha = 1 - F.try_divide((n - 1) * (F.col("only_a") + F.col("only_b")), F.when(expected > 0, expected))
    return counts.select(*keys, (2 * F.col("n")).alias("pairable"), alpha.alias("alpha"))


def exact_set(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of units with the same code set."""
    return aligned.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((sorted_set(F.col("codes_a")) == sorted_set(F.col("codes_b"))).cast("double")).alias("exact"))


def alpha_nominal(values: DataFrame) -> DataFrame:
    """Krippendorff's alpha (nominal) of (unit_id, value), one row per rating; null values are missing.

    Works on counts per unit and value: no pair of ratings is ever formed. Null where no
    unit has two ratings or all ratings are equal.
    """
    per = values.filter("value is not null").groupBy("unit_id", "value").agg(F.count("*").alias("k"))
    units = per.groupBy("unit_id").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk")).filter("m > 1")
    do = units.agg(F.sum((F.col("m") * F.col("m") - F.col("kk")).cast("double") / (F.col("m") - 1)).alias("d"), F.sum("m").alias("n"))
    marg = per.join(units.select("unit_id"), "unit_id", "left_semi").groupBy("value").agg(F.sum("k").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    both = do.withColumn("one", F.lit(1)).join(marg.withColumn("one", F.lit(1)), "one")
    n = F.col("n").cast("double")
    de = (n * n - F.col("cc")) / (n - 1)
    return both.select(F.col("n").alias("pairable"), (1 - F.try_divide(F.col("d"), F.when((n > 1) & (de > 0), de))).alias("alpha"))


def _parts(c: str, kind: int) -> Column:
    return F.array_distinct(F.transform(F.col(c), lambda x: F.try_element_at(F.split(x, "-"), F.lit(kind))))


def dimension_confusion(aligned: DataFrame, none: str = "__none__", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dim_a, dim_b, n): every dimension of one coder against every dimension of the other, per unit."""
    full = lambda c: F.when(F.size(c) > 0, _parts(c, 1)).otherwise(F.array(F.lit(none)))
    return aligned.select(*keys, F.explode(full("codes_a")).alias("dim_a"), full("codes_b").alias("bs")).select(*keys, "dim_a", F.explode("bs").alias("dim_b")).groupBy(*keys, "dim_a", "dim_b").agg(F.count("*").alias("n"))


def polarity_confusion(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dimension, agree, conflict) over units where both coders have the dimension."""
    rows = aligned.select(*keys, "unit_id", F.explode(F.array_intersect(_parts("codes_a", 1), _parts("codes_b", 1))).alias("dimension"), "codes_a", "codes_b")
    own = lambda c: F.array_sort(F.filter(F.col(c), lambda x: F.split(x, "-")[0] == F.col("dimension")))
    same = own("codes_a") == own("codes_b")
    return rows.groupBy(*keys, "dimension").agg(F.sum(same.cast("int")).alias("agree"), F.sum((~same).cast("int")).alias("conflict"))


def precision_recall(aligned: DataFrame, codes: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per code: precision, recall and F1 of b (model) against a (human); F1 is null if either is 0 or null."""
    c = unit_codes(aligned, codes, keys).groupBy(*keys, "code").agg(
        _flag(F.col("a") & F.col("b")).alias("tp"), _flag(~F.col("a") & F.col("b")).alias("fp"), _flag(F.col("a") & ~F.col("b")).alias("fn"))
    d = lambda x: F.col(x).cast("double")
    p, r = F.try_divide(d("tp"), d("tp") + d("fp")), F.try_divide(d("tp"), d("tp") + d("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def disagreements(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Units whose sets differ, with kind polarity (same dimensions), dimension (both coded) or presence, in that order."""
    a, b = (sorted_set(F.col(c)) for c in ("codes_a", "codes_b"))
    dims = lambda c: F.array_sort(_parts(c, 1))
    kind = F.when((F.size(a) == 0) | (F.size(b) == 0), "presence").when(dims("codes_a") == dims("codes_b"), "polarity").otherwise("dimension")
    rank = F.when(kind == "polarity", 0).when(kind == "dimension", 1).otherwise(2)
    return aligned.filter(a != b).select(*keys, "unit_id", kind.alias("kind"), rank.alias("rank"), F.array_join(F.array_except(a, b), "/").alias("only_a"), F.array_join(F.array_except(b, a), "/").alias("only_b")).orderBy("rank", *keys, "unit_id")


def dimension_agreement(aligned: DataFrame, dimensions: list[str] | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Agreement per dimension, polarity ignored."""
    return per_code(aligned.withColumn("codes_a", _parts("codes_a", 1)).withColumn("codes_b", _parts("codes_b", 1)), dimensions, keys)
