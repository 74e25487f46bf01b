"""Sampling frame: quotes located in units, strata, blind sheets, stratified samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.arrays import sorted_set
from codeloom.functions.text import drop_punctuation
from codeloom.session import materialise, small

#: Least length of a contained text, stratum of units without codes, marks that count as ticked.
LEAST, UNMARKED = 10, "__unmarked__"
#: Characters up to which the texts of one key are all compared with each other (about a second of one task); keys with more find their candidates by grams.
COMPARED = 1_000_000_000
TICKED = ("1", "1.0", "v", "V", "✓", "✔", "x", "X", "y", "Y", "yes", "true", "True", "是", "有")


def overlaps(a: Column, b: Column) -> Column:
    """One normalised text contains the other, and the contained one has at least LEAST characters."""
    inside = lambda x, y: (F.length(x) >= LEAST) & F.contains(y, x)
    return inside(a, b) | inside(b, a)


def _grams(c: Column) -> Column:
    """Distinct strings of LEAST characters; none of shorter texts."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c) - LEAST + 1, F.lit(1))), lambda i: i + LEAST - 1 <= F.length(c))
    return F.array_distinct(F.transform(at, lambda i: c.substr(i, F.lit(LEAST))))


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """(i, o) of texts of one key where the inner one (at least LEAST characters) is contained in the outer one.

    ``inner``: key, i, t; ``outer``: key, o, t. A contained text shares every gram with its
    container; each inner text looks for its rarest gram only, and one that has a gram no
    outer text of its key holds is dropped at once. So a key with many texts is not paired
    with itself, and the result is exact.
    """
    og = outer.select(key, "o", F.explode(_grams(F.col("t"))).alias("g"))
    counts = og.groupBy(key, "g").agg(F.count("*").alias("f"))
    ig = inner.select(key, "i", F.explode(_grams(F.col("t"))).alias("g")).join(counts, [key, "g"], "left")
    rare = ig.groupBy(key, "i").agg(F.min_by("g", F.struct("f", "g")).alias("g"), F.min(F.coalesce("f", F.lit(0))).alias("least")).filter("least > 0").select(key, "i", "g")
    # Grams travel with ids alone; texts are fetched for the candidates.
    candidates = rare.join(og, [key, "g"]).select(key, "i", "o").distinct()
    texts = candidates.join(inner.select(key, "i", F.col("t").alias("it")).distinct(), [key, "i"]).join(outer.select(key, "o", F.col("t").alias("ot")).distinct(), [key, "o"])
    return texts.filter(F.contains("ot", F.col("it"))).select("i", "o").distinct()


def large_keys(quotes: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Keys whose quotes and units have more than COMPARED characters to compare, every quote with every unit: (key)."""
    size = lambda df, c: df.groupBy(key).agg(F.count(c).cast("double").alias(f"n_{c}"), F.sum(F.length(c)).cast("double").alias(f"chars_{c}"))
    both = size(quotes, "quote").join(size(units, "text"), key)
    return both.filter(F.col("n_quote") * F.col("chars_text") + F.col("n_text") * F.col("chars_quote") > COMPARED).select(key)


def located(quotes: DataFrame, units: DataFrame, key: str = "respondent") -> DataFrame:
    """(unit_id, quote_id) of quotes and units of one key where one contains the other, once each.

    The texts of a key are compared directly, so they travel once; only keys with too many
    for that (:func:`large_keys`) go through :func:`contained`. Both ways give the same
    pairs. Null texts and keys match nothing.
    """
    q = quotes.select(key, "quote_id", "quote").filter(F.col(key).isNotNull() & F.col("quote").isNotNull())
    u = units.select(key, "unit_id", "text").filter(F.col(key).isNotNull() & F.col("text").isNotNull())
    large = materialise(large_keys(q, u, key), "large_keys")
    some = not large.isEmpty()
    large = small(large)
    part = lambda df, how: df.join(large, key, how) if some else df
    clean = lambda df, i, c: df.select(key, i, drop_punctuation(F.col(c)).alias(c))
    pairs = clean(part(q, "left_anti"), "quote_id", "quote").join(clean(part(u, "left_anti"), "unit_id", "text"), key).filter(overlaps(F.col("text"), F.col("quote"))).select("unit_id", "quote_id")
    if some:
        ql, ul = materialise(clean(part(q, "left_semi"), "quote_id", "quote"), "large_quotes"), materialise(clean(part(u, "left_semi"), "unit_id", "text"), "large_units")
        of = lambda df, i, c, name: df.select(key, F.col(i).alias(name), F.col(c).alias("t"))
        a = contained(of(ql, "quote_id", "quote", "i"), of(ul, "unit_id", "text", "o"), key).select(F.col("o").alias("unit_id"), F.col("i").alias("quote_id"))
        b = contained(of(ul, "unit_id", "text", "i"), of(ql, "quote_id", "quote", "o"), key).select(F.col("i").alias("unit_id"), F.col("o").alias("quote_id"))
        pairs = pairs.unionByName(a).unionByName(b)
    return pairs.distinct()


def locate_quotes(quotes: DataFrame, units: DataFrame, key: str = "respondent") -> DataFrame:
    """(unit_id, quote_id, codes) of quotes and units of one key where one contains the other; see :func:`located`."""
    return located(quotes, units, key).join(quotes.select("quote_id", "codes"), "quote_id").select("unit_id", "quote_id", "codes")


def build_frame(quotes: DataFrame, units: DataFrame, key: str = "respondent") -> DataFrame:
    """Units of respondents with the union of the codes located in them and their stratum."""
    found = locate_quotes(quotes, units.filter("role = 'respondent'"), key).groupBy("unit_id").agg(sorted_set(F.flatten(F.collect_list("codes"))).alias("ai_codes"))
    out = units.filter("role = 'respondent'").join(found, "unit_id", "left").withColumn("ai_codes", F.coalesce("ai_codes", F.array().cast("array<string>")))
    return out.withColumn("stratum", F.when(F.size("ai_codes") > 0, F.array_join("ai_codes", "+")).otherwise(UNMARKED))


def unmatched(quotes: DataFrame, units: DataFrame, key: str = "respondent") -> DataFrame:
    """Quotes found in no unit."""
    return quotes.join(locate_quotes(quotes, units, key).select("quote_id").distinct(), "quote_id", "left_anti")


def frame_diagnostics(quotes: DataFrame, units: DataFrame, key: str = "respondent") -> DataFrame:
    """(respondent, quotes, framed, on_excluded, unmatched): where the quotes of every respondent lie.

    framed: in a unit of a respondent; on_excluded: only in units left out of the frame
    (interviewers, headers); unmatched: in none.
    """
    found = locate_quotes(quotes, units, key).join(units.select("unit_id", (F.col("role") == "respondent").alias("inside")).distinct(), "unit_id")
    where = found.groupBy("quote_id").agg(F.max("inside").alias("inside"))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return quotes.select(key, "quote_id").join(where, "quote_id", "left").groupBy(key).agg(
        F.count("*").alias("quotes"), flag(F.col("inside")).alias("framed"), flag(~F.col("inside")).alias("on_excluded"), F.sum(F.col("inside").isNull().cast("int")).alias("unmatched"))


def coding_sheet(frame: DataFrame, codes: list[str]) -> DataFrame:
    """Blind sheet: unit, text and one empty column per code; what the model said is left out."""
    return frame.select("unit_id", "text", *[F.lit("").alias(c) for c in codes], F.lit("").alias("comment"))


def parse_sheet(sheet: DataFrame, codes: list[str], units: DataFrame) -> DataFrame:
    """(unit_id, codes) of every unit of the frame; ids that are not in it are dropped, unticked units have none."""
    ticked = F.array_sort(F.array_compact(F.array(*[F.when(F.trim(F.col(f"`{c}`").cast("string")).isin(*TICKED), F.lit(c)) for c in codes])))
    got = sheet.select("unit_id", ticked.alias("codes")).groupBy("unit_id").agg(sorted_set(F.flatten(F.collect_list("codes"))).alias("codes"))
    return units.select("unit_id").distinct().join(got, "unit_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def stratified_sample(frame: DataFrame, codes: list[str], n: int = 100, seed: int = 42, per_code: int = 4, unmarked_share: float = 0.35) -> DataFrame:
    """Seeded sample of the units of one framework: (unit_id, draw); see :func:`stratified_samples`."""
    order = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    one = frame.select("unit_id", "ai_codes", F.lit("").alias("__one"))
    return stratified_samples(one, order, "__one", n, seed, per_code, unmarked_share).select("unit_id", "draw")


def _quotas(candidates: DataFrame, key: str, per_code: int) -> DataFrame:
    """(key, unit_id): code by code in framework order up to ``per_code`` units that hold it and are not taken yet.

    ``candidates``: key, unit_id, code, place (of the code), r (rank within the code). They
    are few: per_code times the square of the framework's codes.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, None] = {}
        for _, pool in pdf.sort_values(["place", "r"]).groupby("place", sort=True):
            taken |= dict.fromkeys([u for u in pool["unit_id"] if u not in taken][:per_code])
        return pd.DataFrame({key: pdf[key].iloc[0], "unit_id": list(taken)})

    kinds = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in (key, "unit_id"))
    return candidates.groupBy(key).applyInPandas(one, kinds)


def stratified_samples(frame: DataFrame, codes: Column, key: str = "framework_id", n: int = 100, seed: int = 42, per_code: int = 4, unmarked_share: float = 0.35) -> DataFrame:
    """Seeded sample of units of every ``key``: (key, unit_id, draw), ``draw`` being the order of the draw.

    ``codes`` is a column of the row's codes in framework order. A fixed share is of
    unmarked units; of every code in order up to ``per_code`` units that hold it are taken
    that are not taken yet; the rest comes from the other marked units; without marked units
    n of all are drawn. Order within a stratum is a seeded hash, so the sample does not
    depend on partitions. Repeated rows of a unit are one unit, null ids none.
    """
    rows = frame.filter("unit_id is not null").select(key, "unit_id", sorted_set(F.col("ai_codes")).alias("codes"), codes.alias("order"), F.xxhash64(F.lit(seed), "unit_id").alias("h")).dropDuplicates([key, "unit_id"])
    marked = F.size("codes") > 0
    totals = rows.groupBy(F.col(key).alias("__key")).agg(F.sum(marked.cast("int")).alias("m"), F.sum((~marked).cast("int")).alias("u"))
    widest = rows.agg(F.max(F.size("order"))).first()[0] or 0
    # Only the first of a stratum can be drawn: Spark applies these limits before the shuffle.
    rank = lambda df, most, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(key, *by).orderBy("h", "unit_id"))).filter(F.col("r") <= most)
    held = rows.select(key, "unit_id", "h", "order", F.explode(F.array_intersect("codes", "order")).alias("code"))
    held = rank(held, max(1, per_code * widest), "code").withColumn("place", F.array_position("order", F.col("code")))
    quota = materialise(_quotas(held.select(key, "unit_id", "code", "place", "r"), key, per_code), "quota")
    # With the quotas at most n + per_code * widest of the first marked units are needed.
    taken = quota.select(F.col(key).alias("__k"), F.col("unit_id").alias("__u"))
    others = rank(rows.filter(marked), n + per_code * widest).drop("r").join(taken, F.col(key).eqNullSafe(F.col("__k")) & (F.col("unit_id") == F.col("__u")), "left_anti")
    others, got = rank(others, n), taken.groupBy("__k").agg(F.count("*").alias("got"))
    k_un = F.least("u", F.lit(round(n * unmarked_share)))
    room = totals.join(got, F.col("__key").eqNullSafe(F.col("__k")), "left").select(
        "__key", F.when(F.col("m") > 0, k_un).otherwise(n).alias("blank"), F.when(F.col("m") > 0, F.greatest(F.lit(0), F.least("m", n - k_un) - F.coalesce("got", F.lit(0)))).otherwise(0).alias("rest"))
    fit = lambda df, c: df.join(room, F.col(key).eqNullSafe(F.col("__key"))).filter(F.col("r") <= F.col(c)).select(key, "unit_id")
    picked = quota.select(key, "unit_id").unionByName(fit(others, "rest")).unionByName(fit(rank(rows.filter(~marked), n), "blank"))
    again = F.xxhash64(F.lit(seed + 1), "unit_id")
    return picked.withColumn("draw", F.row_number().over(Window.partitionBy(key).orderBy(again, "unit_id"))).select(key, "unit_id", "draw")


def frame_counts(units: DataFrame) -> DataFrame:
    """Units per role and how many are excluded from the frame."""
    return units.groupBy("role").agg(F.count("*").alias("n")).withColumn("in_frame", F.col("role") == "respondent")
