"""Literature: works from an offline cache, abstracts, citations, guarded drafts, bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.distributed import running

WORK = (
    "id string, doi string, title string, publication_year int, cited_by_count int, type string, "
    "abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>"
)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Works of cached JSON answers (``results`` arrays); damaged files give no rows."""
    raw = spark.read.schema(f"results array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in WORK.split(', ')))}>>, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.select(F.explode("results").alias("w")).select("w.*")


def abstract_text(index: Column) -> Column:
    """Text of an inverted index: words in order of their positions; null for null."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


def normalise(works: DataFrame) -> DataFrame:
    """Flat works: id, doi, title, year, venue, authors, abstract, cited."""
    authors = F.array_compact(F.transform(F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: a["author"]["display_name"]))
    return works.select(F.regexp_extract("id", r"([^/]+)$", 1).alias("work_id"), F.regexp_replace("doi", r"^https?://doi\.org/", "").alias("doi"), "title", F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("venue"), authors.alias("authors"), abstract_text(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce("cited_by_count", F.lit(0)).alias("cited"))


def citation(authors: Column, year: Column) -> Column:
    """Names and year: one, up to three, or the first and et al.; n.d. without a year."""
    last = F.transform(authors, lambda a: F.element_at(F.split(F.trim(a), r"\s+"), -1))
    who = F.when(F.size(last) == 0, "Unknown").when(F.size(last) == 1, last[0]).when(F.size(last) <= 3, F.concat(F.array_join(F.slice(last, F.lit(1), F.size(last) - 1), ", "), F.lit(" & "), F.element_at(last, -1))).otherwise(F.concat(last[0], F.lit(" et al.")))
    return F.concat(who, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def suggest_topics(topics: DataFrame, n: int = 8) -> DataFrame:
    """(id, name, description, works_count, field) of the first ``n`` answers of a topic search (``rank``, raw JSON as ``raw``): a report of what a theory's name may mean."""
    get = lambda p: F.get_json_object("raw", p)
    return topics.orderBy("rank").limit(n).select(
        F.element_at(F.split(F.coalesce(get("$.id"), F.lit("")), "/"), -1).alias("id"), F.coalesce(get("$.display_name"), F.lit("")).alias("name"), F.coalesce(get("$.description"), F.lit("")).alias("description"),
        F.coalesce(get("$.works_count").cast("bigint"), F.lit(0)).alias("works_count"), F.coalesce(get("$.field.display_name"), F.lit("")).alias("field"))


def evidence(works: DataFrame, most: int = 1100) -> DataFrame:
    """Works tagged W1.. in order of ``rank``, abstracts cut at a word."""
    cut = F.when(F.length("abstract") <= most, F.col("abstract")).otherwise(F.concat(F.regexp_replace(F.substring("abstract", 1, most), r"\s+\S*$", ""), F.lit("…")))
    return running(works, ["rank", "work_id"], number="__no").withColumn("tag", F.concat(F.lit("W"), "__no")).drop("__no").withColumn("excerpt", cut)


def union_passes(passes: DataFrame) -> DataFrame:
    """Works of several retrieval passes, each once: the earliest pass wins (ties: best rank)."""
    w = Window.partitionBy("work_id").orderBy("pass_no", "rank")
    return passes.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def relevance(works: DataFrame, terms: list[str]) -> DataFrame:
    """Share of works whose title or abstract mentions any term; null without works."""
    hay = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(hay, F.lit(t.lower()))
    return works.agg(F.avg(hit.cast("double")).alias("relevance"), F.count("*").alias("works"))


def guard_citations(draft: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grounded dimensions with their valid refs, invalid refs). ``draft``: dimension, refs; a dimension without a valid ref is dropped."""
    refs = draft.select("dimension", F.explode("refs").alias("ref")).distinct()
    known = works.select(F.col("tag").alias("ref")).distinct()
    good = refs.join(known, "ref", "left_semi").groupBy("dimension").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    return good, refs.join(known, "ref", "left_anti")


def decide(draft: DataFrame, decisions: DataFrame) -> DataFrame:
    """Draft dimensions with a decision; what nobody decided is rejected."""
    return draft.join(decisions.select("dimension", "decision", "reviewer"), "dimension", "left").withColumn("decision", F.coalesce(F.when(F.trim("reviewer") != "", F.col("decision")), F.lit("reject")))


def bibliography(uses: DataFrame) -> DataFrame:
    """Works once each: strongest role (founding, supporting, contrast) and the dimensions they serve."""
    role = F.when(F.col("role") == "founding", 0).when(F.col("role") == "supporting", 1).otherwise(2)
    return uses.groupBy("work_id").agg(F.min_by("role", role).alias("role"), F.array_sort(F.collect_set("dimension")).alias("dimensions"))
