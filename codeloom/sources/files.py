"""Records, codebooks, lexicons and sheets from folders of files; one bad file costs one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.framework import Framework
from codeloom.operators.migrate import migrate_records
from codeloom.sources.nested import link_nodes, node_table, payload_status, segment_table


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(raw_id, file_path, payload, modified, status) of every JSON file; raw_id is a hash of the path."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("payload"))
    return payload_status(raw.withColumn("raw_id", F.xxhash64("file_path")))


def record_segments(payloads: DataFrame) -> DataFrame:
    """Segments of all readable payloads, with their attributes."""
    return segment_table(link_nodes(node_table(payloads, attributes=True)))


def saved_index(records: DataFrame) -> DataFrame:
    """Metadata of saved records without their texts."""
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return records.select("record_id", "respondent", F.col("_meta.framework_id").alias("framework_id"), F.col("_meta.coded_at").alias("coded_at"), n("segments").alias("segments"), n("deleted_segments").alias("deleted"))


CODEBOOK = "codebook_id string, language string, created string, corpus_term string, codes array<struct<code_id:string,label:string,definition:string,count:int,first_seen_chunk:int,examples:array<struct<quote:string,respondent:string>>,merged_from:array<string>>>"


def read_codebooks(spark: SparkSession, path: str) -> DataFrame:
    """Codebooks of a folder with the file's modification time; damaged files give null ids and are dropped."""
    return spark.read.schema(CODEBOOK).option("multiLine", True).json(path).select("*", F.col("_metadata.file_modification_time").alias("modified")).filter("codebook_id is not null")


def save_codebooks(codebooks: DataFrame, path: str) -> None:
    """Codebooks as JSON lines of the shape that :func:`read_codebooks` reads; an existing folder is not overwritten."""
    codebooks.write.mode("errorifexists").json(path)


def scan_records(spark: SparkSession, path: str, fw: Framework) -> DataFrame:
    """Every JSON file of a folder, migrated: path, record, dropped, mismatch, error. Damaged files keep their row."""
    return migrate_records(read_payloads(spark, path), fw).drop("payload")


def newest_codebook(codebooks: DataFrame) -> DataFrame:
    """The codebook saved last (ties: greatest id)."""
    best = codebooks.agg(F.max_by("codebook_id", F.struct("modified", "codebook_id")).alias("codebook_id"))
    return codebooks.join(F.broadcast(best), "codebook_id")


def checkpoint_records(open_records: DataFrame, codebook: DataFrame) -> DataFrame:
    """Open records made with the given codebook."""
    return open_records.withColumn("codebook_id", F.col("_meta.codebook_id")).join(codebook.select("codebook_id").distinct(), "codebook_id", "left_semi")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A filled coding sheet (csv with a header), everything as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def load_lexicon(data: dict) -> tuple[dict, list[str]]:
    """A lexicon definition in the present shape and the ids of patterns that do not compile. Idempotent."""
    import re

    terms = data.get("terms")
    if terms is None:
        terms = [[d, p, t] for d, poles in (data.get("concept_terms") or {}).items() for p, ts in poles.items() for t in ts]
    bad, patterns = [], []
    for p in data.get("patterns") or []:
        try:
            re.compile(p[3])
            patterns.append(list(p))
        except (re.error, IndexError, TypeError):
            bad.append(str(p[0]) if p else "")
    out = {"terms": [list(t) for t in terms], "patterns": patterns}
    return out | {k: list(data.get(k) or []) for k in ("negators", "intensifiers", "pivots", "reported")}, bad


def save_lexicon(data: dict, path: str) -> None:
    """Write a lexicon; an empty one never replaces one with terms."""
    import json
    from pathlib import Path

    target = Path(path)
    if target.exists() and not data.get("terms") and json.loads(target.read_text("utf-8")).get("terms"):
        raise ValueError("an empty lexicon would replace one with terms")
    target.write_text(json.dumps(data, ensure_ascii=False, indent=1), "utf-8")
