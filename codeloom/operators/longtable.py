"""The long table: one row per segment and distinct valid code, from nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.labels import dimension_of, framework_rows, polarity_of


def first_rows(records: DataFrame) -> DataFrame:
    """One row per record_id: the one saved last (ties: received last). Rows without an id are kept as they are.

    An aggregate per column: repeated rows are reduced before the shuffle, and columns that
    nobody reads are pruned.
    """
    order = F.struct("saved_at", "received_at")
    others = [c for c in records.columns if c != "record_id"]
    kept = records.filter("record_id is not null").groupBy("record_id").agg(*[F.max_by(c, order).alias(c) for c in others])
    return kept.select(*records.columns).unionByName(records.filter("record_id is null"))


def segments_of(records: DataFrame, lists: tuple[str, ...] = ("segments",)) -> DataFrame:
    """(record_id, respondent, framework_id, descriptors, endpoint, list_name, seg_pos, segment struct); null entries keep their position and are dropped."""
    out = None
    for name in lists:
        part = records.select("record_id", "respondent", F.col("_meta.framework_id").alias("framework_id"), "descriptors",
                              F.coalesce("_meta.endpoint.endpoint", "_meta.source", F.lit("")).alias("endpoint"), F.lit(name).alias("list_name"), F.posexplode(name).alias("seg_pos", "segment")).filter("segment is not null")
        out = part if out is None else out.unionByName(part)
    return out


def segment_text(segment: Column) -> Column:
    """Text of a segment: full_text, or the quote where that is null or blank."""
    return F.coalesce(F.when(F.trim(segment["full_text"]) != "", segment["full_text"]), segment["quote"])


def menu_labels(records: DataFrame) -> DataFrame:
    """(record_id, label): the respondent, with the file where several records share the name."""
    w = Window.partitionBy("respondent")
    name = F.coalesce("respondent", F.lit("unknown"))
    return records.select("record_id", F.when(F.count("*").over(w) > 1, F.concat(name, F.lit(" ("), F.coalesce("transcript_file", F.col("record_id").cast("string")), F.lit(")"))).otherwise(name).alias("label"))


def code_rows(records: DataFrame, frameworks: DataFrame, lists: tuple[str, ...] = ("segments",)) -> DataFrame:
    """Every code entry with its clean dimension and polarity, null where it names none."""
    rows = framework_rows(frameworks)
    codes = segments_of(records, lists).select("*", F.posexplode("segment.codes").alias("code_pos", "c")).filter("c is not null")
    return codes.withColumn("dimension", dimension_of(rows, F.col("framework_id"), F.col("c.dimension"))).withColumn("polarity", polarity_of(rows, F.col("framework_id"), F.col("c.polarity")))


def code_string(rows: list, framework: Column, dimension: Column, polarity: Column) -> Column:
    """SHORT-POLARITY, or SHORT where the framework has no polarity."""
    shorts = F.create_map(*[F.lit(x) for r in rows for x in (f"{r.framework_id}\x1f{r.dimension}", r.short_code)])
    short = F.try_element_at(shorts, F.concat(framework, F.lit("\x1f"), dimension))
    return F.concat(short, F.when(polarity == "", "").otherwise(F.concat(F.lit("-"), polarity)))


def codes_of(rows: list, framework: Column) -> Column:
    """All codes of the framework in its order; an empty array where ``rows`` hold no such framework."""
    own: dict[str, list[str]] = {}
    for r in rows:
        own.setdefault(r.framework_id, []).extend(f"{r.short_code}-{p}" for p in r.polarity_values) if r.polarity_values else own.setdefault(r.framework_id, []).append(r.short_code)
    return _lookup(own, framework)


def dimensions_of(rows: list, framework: Column, field: str = "short_code") -> Column:
    """``field`` of all dimensions of the framework in its order; an empty array where ``rows`` hold no such framework."""
    own: dict[str, list[str]] = {}
    for r in rows:
        own.setdefault(r.framework_id, []).append(r[field])
    return _lookup(own, framework)


def _lookup(lists: dict[str, list[str]], key: Column) -> Column:
    none = F.array().cast("array<string>")
    if not lists:
        return none
    known = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, key), none)


def build_long(records: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(record_id, respondent, framework_id, seg_pos, segment_id, dimension, polarity, code, rationale,
    multi_coded, codes_in_segment, title, quote, full_text, status, source, endpoint, descriptors).

    The codes of a segment are a set: repeated (dimension, polarity) become one row, whose
    rationale joins the distinct ones in order of appearance. Entries that name no dimension
    or lack a valid polarity where one is needed are left out.
    """
    rows = framework_rows(frameworks)
    valid = code_rows(records, frameworks).filter("dimension is not null and polarity is not null")
    key = ["record_id", "seg_pos"]
    why = F.transform(F.array_sort(F.collect_list(F.when(F.trim("c.rationale") != "", F.struct("code_pos", F.trim("c.rationale").alias("r"))))), lambda x: x["r"])
    # Separate aggregates, so that those a caller does not use are pruned before the shuffle.
    first = lambda field, alias, default=None: F.first(F.coalesce(F.col(field), F.lit(default)) if default else F.col(field)).alias(alias)
    grouped = valid.groupBy(*key, "respondent", "framework_id", "dimension", "polarity").agg(
        F.array_join(F.array_distinct(why), "; ").alias("rationale"), first("segment.segment_id", "segment_id"), first("segment.title", "title"), first("segment.quote", "quote"), first("segment.full_text", "full_text"),
        first("segment.review.status", "status", "pending"), first("segment.review.source", "source", "ai"), first("endpoint", "endpoint"), first("descriptors", "descriptors"))
    n = F.count("*").over(Window.partitionBy(*key))
    return grouped.withColumn("codes_in_segment", n).select(
        *key, "respondent", "framework_id", "segment_id", "dimension", "polarity", code_string(rows, F.col("framework_id"), F.col("dimension"), F.col("polarity")).alias("code"),
        "rationale", (F.col("codes_in_segment") > 1).alias("multi_coded"), "codes_in_segment", "title", "quote", "full_text", "status", "source", "endpoint", "descriptors")


def coverage(records: DataFrame, long: DataFrame) -> DataFrame:
    """Per record: segments, codes, dimensions, multi-coded share, descriptors filled; records without codes stay, with 0."""
    base = records.select("record_id", "respondent", F.size(F.filter(F.coalesce("segments", F.array()), lambda s: s.isNotNull())).alias("segments"),
                          F.size(F.filter(F.map_values("descriptors"), lambda v: v.isNotNull() & ~v.isin("", "unspecified"))).alias("filled"))
    c = long.groupBy("record_id").agg(F.count("*").alias("codes"), F.countDistinct("seg_pos").alias("coded"), F.countDistinct("dimension").alias("dimensions"), F.countDistinct(F.when(F.col("multi_coded"), F.col("seg_pos"))).alias("multi"))
    out = base.join(c, "record_id", "left").fillna(0, ["codes", "coded", "dimensions", "multi"])
    return out.withColumn("filled", F.greatest("filled", F.lit(0))).withColumn("multi_rate", F.try_divide(F.col("multi").cast("double"), F.col("coded").cast("double")))
