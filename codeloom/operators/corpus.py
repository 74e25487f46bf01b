"""Corpora and records built from marks, codings and reference codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.framework import UNSPECIFIED
from codeloom.functions.arrays import sorted_set

#: Fixed value: greatest span in characters that codes of one answer share a segment in.
SPAN = 240


def reference_segments(codes: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """(keys, seg_no, start_pos, end_pos, codes) from codes with spans (start_pos, end_pos, code) of one answer.

    In order of their places, a code joins the open segment while the covering span stays
    within ``span``; else it opens the next one. Codes without a place are dropped. The fold
    runs over one answer's codes.
    """
    rows = codes.filter("start_pos is not null and end_pos is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "code"))).alias("c"))
    segment = "array<struct<start_pos:int,end_pos:int,codes:array<string>>>"

    def step(acc, x):  # noqa: ANN001, ANN202
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(F.greatest(last["end_pos"], x["end_pos"]) - last["start_pos"] <= span, F.lit(False))
        grown = F.struct(last["start_pos"].alias("start_pos"), F.greatest(last["end_pos"], x["end_pos"]).alias("end_pos"), F.array_union(last["codes"], F.array(x["code"])).alias("codes"))
        new = F.struct(x["start_pos"].cast("int").alias("start_pos"), x["end_pos"].cast("int").alias("end_pos"), F.array(x["code"]).alias("codes"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new))).cast(segment)

    folded = rows.select(*keys, F.aggregate("c", F.array().cast(segment), step).alias("s"))
    return folded.select(*keys, F.posexplode("s").alias("p", "s")).select(*keys, (F.col("p") + 1).alias("seg_no"), "s.*")


def sector_subset(people: DataFrame, order: list[str], n: int = 6, seed: int = 7) -> DataFrame:
    """At most ``n`` people per sector in seeded order, everyone once, in their first sector (a sampling operator)."""
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.coalesce("sector", F.lit("")))
    first = people.filter("person is not null").withColumn("p", F.when(pos == 0, 10**6).otherwise(pos)).groupBy("person").agg(F.min_by("sector", F.struct("p", "sector")).alias("sector"))
    w = Window.partitionBy("sector").orderBy(F.xxhash64(F.lit(seed), "person"), "person")
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def records_from_codings(codings: DataFrame, units: DataFrame) -> DataFrame:
    """Records of one coder's latest codings: (session_id, coder, respondent, segments).

    ``codings``: session_id, coder, unit_id, codes (strings). Units without codes give no
    segment; segments are numbered in unit order within a respondent.
    """
    coded = codings.withColumn("codes", sorted_set(F.col("codes"))).filter(F.size("codes") > 0)
    u = units.select("unit_id", F.coalesce("respondent", F.lit(UNSPECIFIED)).alias("respondent"), "unit_position", "text")
    w = Window.partitionBy("session_id", "coder", "respondent").orderBy("unit_position", "unit_id")
    seg = coded.join(u, "unit_id").withColumn("n", F.row_number().over(w))
    one = F.struct("n", F.format_string("S%03d", F.col("n")).alias("segment_id"), F.col("text").alias("quote"), F.col("text").alias("full_text"), "codes", F.col("unit_id"))
    return seg.groupBy("session_id", "coder", "respondent").agg(F.array_sort(F.collect_list(one)).alias("segments"))


def record_from_marks(marks: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, segments) from a reader's marks (start_pos, end_pos, text, codes, comment), in order of their places; marks without codes give none."""
    m = marks.withColumn("codes", sorted_set(F.col("codes"))).filter(F.size("codes") > 0)
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_pos", "end_pos"))
    one = F.struct("n", F.format_string("S%03d", F.col("n")).alias("segment_id"), F.col("text").alias("quote"), "codes", "comment", F.lit("human").alias("source"))
    return m.withColumn("n", n).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("segments"))


def open_to_standard(rows: DataFrame, code_dimension: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open codes as framework codes: (record_id, seg_pos, dimension) and the records of which every code was dropped."""
    joined = rows.join(code_dimension.select("codebook_id", "label", "dimension"), ["codebook_id", "label"], "left")
    kept = joined.filter("dimension is not null").select("record_id", "seg_pos", "dimension").distinct()
    lost = joined.groupBy("record_id").agg(F.max(F.col("dimension").isNotNull()).alias("any")).filter("not any").select("record_id")
    return kept, lost


def methods_facts(records: DataFrame, events: DataFrame) -> DataFrame:
    """One row for a methods section: records, respondents, frameworks, models, review events and reviewers."""
    a = records.agg(F.count("*").alias("records"), F.countDistinct("respondent").alias("respondents"), F.array_join(F.array_sort(F.collect_set("_meta.framework_id")), ", ").alias("frameworks"), F.array_join(F.array_sort(F.collect_set("_meta.endpoint.model")), ", ").alias("models"))
    b = events.agg(F.count("*").alias("events"), F.countDistinct("reviewer").alias("reviewers"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def label_lookup(keys: DataFrame, labels: DataFrame, lang: str) -> DataFrame:
    """(key, label): label in ``lang``, else in English, else the key. ``labels``: key, lang, label."""
    own = labels.filter(F.col("lang") == lang).select("key", F.col("label").alias("own"))
    en = labels.filter("lang = 'en'").select("key", F.col("label").alias("en"))
    return keys.join(own, "key", "left").join(en, "key", "left").select("key", F.coalesce("own", "en", "key").alias("label"))


def missing_labels(labels: DataFrame, langs: list[str]) -> DataFrame:
    """(key, lang) of labels that are not there."""
    want = labels.select("key").distinct().select("key", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    return want.join(labels.filter(F.trim("label") != "").select("key", "lang").distinct(), ["key", "lang"], "left_anti")
