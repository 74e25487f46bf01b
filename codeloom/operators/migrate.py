"""Records of older shapes and unclean values brought to the present one, with reasons for what is dropped."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.framework import OTHER, UNSPECIFIED, Framework
from codeloom.functions.labels import dimension_of, framework_rows, polarity_of
from codeloom.functions.text import ABSENCE, is_absence
from codeloom.operators.longtable import segments_of
from codeloom.sources.nested import parse_payload

REASONS = ("malformed", "unknown_dimension", "no_polarity", "absence_as_evidence", "duplicate")


def code_audit(records: DataFrame, frameworks: DataFrame, lists: tuple[str, ...] = ("segments",)) -> DataFrame:
    """Every code entry with its clean values and the reason it is dropped for (null: kept).

    Order of the tests: malformed (null entry or null dimension), unknown_dimension,
    no_polarity, absence_as_evidence, duplicate (same dimension, polarity and trimmed
    rationale earlier in the segment).
    """
    rows = framework_rows(frameworks)
    c = segments_of(records, lists).select("record_id", "framework_id", "list_name", "seg_pos", F.posexplode("segment.codes").alias("code_pos", "c"))
    c = c.withColumn("dimension", dimension_of(rows, F.col("framework_id"), F.col("c.dimension"))).withColumn("polarity", polarity_of(rows, F.col("framework_id"), F.col("c.polarity"))).withColumn("rationale", F.coalesce(F.trim("c.rationale"), F.lit("")))
    reason = (
        F.when(F.col("c.dimension").isNull() | (F.trim("c.dimension") == ""), "malformed").when(F.col("dimension").isNull(), "unknown_dimension").when(F.col("polarity").isNull(), "no_polarity")
        .when(is_absence(F.col("rationale")), "absence_as_evidence")
    )
    c = c.withColumn("reason", reason)
    w = Window.partitionBy("record_id", "list_name", "seg_pos", "dimension", "polarity", "rationale", F.col("reason").isNull()).orderBy("code_pos")
    dup = F.row_number().over(w) > 1
    return c.withColumn("reason", F.when(F.col("reason").isNull() & dup, "duplicate").otherwise(F.col("reason"))).drop("c")


def drop_summary(audit: DataFrame) -> DataFrame:
    """(reason, n) of dropped entries."""
    return audit.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def descriptor_value(value: Column, allowed: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Clean descriptor value: unspecified for null or blank, other for what is not allowed."""
    key = F.lower(F.trim(value))
    v = key
    for a, b in (aliases or {}).items():
        v = F.when(key == a.lower(), F.lit(b)).otherwise(v)
    return F.when(value.isNull() | (key == ""), UNSPECIFIED).when(v.isin(*allowed, UNSPECIFIED), v).otherwise(OTHER)


def from_v1(rows: DataFrame) -> DataFrame:
    """Oldest shape (record_id, dimension, polarity, full_text, quote, rationale; one row per coded passage) to segments.

    Passages with the same full text become one segment whose codes are all of theirs.
    """
    code = F.struct("dimension", "polarity", "rationale")
    w = Window.partitionBy("record_id").orderBy("first")
    out = rows.filter("full_text is not null").groupBy("record_id", "full_text").agg(F.min("ord").alias("first"), F.min_by("quote", "ord").alias("quote"), F.transform(F.array_sort(F.collect_list(F.struct("ord", code.alias("c")))), lambda x: x["c"]).alias("codes"))
    return out.withColumn("segment_id", F.format_string("S%03d", F.row_number().over(w))).drop("first")


#: Field names of earlier shapes and of the present one.
FIELDS = {"respondent": ("respondent", "受訪者", "name"), "summary": ("summary", "摘要"), "transcript": ("transcript", "逐字稿"), "segments": ("segments", "段落", "編碼段落")}


def migrate_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON text of any shape to (…, respondent, summary, transcript, segments_json, schema_version), by the first field name that is there. Idempotent."""
    get = lambda names: F.coalesce(*[F.get_json_object(F.col(payload), f"$['{n}']") for n in names])
    version = F.get_json_object(F.col(payload), "$._meta.schema_version").cast("int")
    legacy = F.get_json_object(F.col(payload), "$['受訪者']").isNotNull()
    return df.select("*", *[get(v).alias(k if k != "segments" else "segments_json") for k, v in FIELDS.items()], F.coalesce(version, F.when(legacy, 2).otherwise(3)).alias("schema_version"))


def framework_mismatch(records: DataFrame, framework_id: str) -> DataFrame:
    """Records made with another framework; those that name none pass."""
    return records.filter(F.col("_meta.framework_id") != framework_id)


def degenerate_titles(segments: DataFrame, names: list[str]) -> DataFrame:
    """Segments whose title is only a dimension, code or label, perhaps with a polarity after it."""
    bare = F.lower(F.trim(F.regexp_replace(F.col("title"), r"\s*[-—:(（]\s*\p{Lu}\s*[)）]?$", "")))
    return segments.filter(bare.isin([n.lower() for n in names]))


# --- Fixed values: names that earlier shapes gave the fields of each level, and values they wrote ---
EARLIER_NAMES = {
    "record": {"受訪者": "respondent", "屬性": "descriptors", "編碼段落": "segments", "已刪除段落": "deleted_segments", "維度重點分析": "summary", "逐字稿": "transcript", "逐字稿檔名": "transcript_file", "_來源": "_source", "_檔名": "_file"},
    "segment": {"段落ID": "segment_id", "標題": "title", "精簡引文": "quote", "完整原文": "full_text", "編碼": "codes", "審核": "review"},
    "code": {"維度": "dimension", "極性": "polarity", "理由": "rationale"},
    "review": {"狀態": "status", "原始編碼": "original_codes", "原始標題": "original_title", "原始精簡引文": "original_quote", "來源": "source", "編輯紀錄": "history"},
    "event": {"時間": "time", "動作": "action", "說明": "detail", "複核者": "reviewer"},
}
EARLIER_STATUS = {"未審核": "pending", "已確認": "confirmed", "已修改": "modified", "人工新增": "added", "已刪除": "deleted"}
EARLIER_SOURCE = {"AI": "ai", "人工": "human"}
EARLIER_DIMENSIONS = {"預期": "anticipation", "反思性": "reflexivity", "參與": "engagement", "回應性": "responsiveness", "未歸屬": "unassigned"}
SCHEMA_VERSION = 3
_ABSENT = re.compile(ABSENCE)


def _present(raw: dict, level: str) -> dict:
    """An object with the present names of its fields; a field under both names keeps the present one."""
    names = EARLIER_NAMES[level]
    return {names[k]: v for k, v in raw.items() if k in names} | {k: v for k, v in raw.items() if k not in names}


class RecordMigration:
    """Brings records of any shape to the present one for a framework; notes every code it drops with the reason."""

    def __init__(self, fw: Framework) -> None:
        self.fw = fw
        self.spellings = {" ".join(str(x).replace("_", " ").lower().split()): d.id for d in fw.dimensions for x in (d.id, d.short, *(t for _, t in d.labels))}
        self.spellings |= {k: v for k, v in EARLIER_DIMENSIONS.items() if any(v == d.id for d in fw.dimensions)}
        self.dropped: list[dict] = []

    def codes(self, raw: object, segment_id: str) -> list[dict]:
        kept: dict[tuple, dict] = {}
        for c in raw if isinstance(raw, list) else []:
            if not isinstance(c, dict):
                self.dropped.append({"segment_id": segment_id, "reason": "malformed", "dimension": None, "polarity": None, "rationale": str(c)[:80]})
                continue
            c = _present(c, "code")
            dimension = self.spellings.get(" ".join(str(c.get("dimension") or "").replace("_", " ").lower().split()))
            polarity = str(c.get("polarity") or "").strip().upper()
            polarity = polarity if polarity in self.fw.polarities else None
            rationale = str(c.get("rationale") or "")
            key = dimension, polarity, rationale.strip()
            tests = (("unknown_dimension", dimension is None), ("no_polarity", self.fw.has_polarity and polarity is None), ("absence_as_evidence", bool(_ABSENT.search(rationale))), ("duplicate", key in kept))
            if reason := next((name for name, failed in tests if failed), None):
                self.dropped.append({"segment_id": segment_id, "reason": reason, "dimension": c.get("dimension"), "polarity": c.get("polarity"), "rationale": rationale})
            else:
                kept[key] = {"dimension": dimension, "polarity": polarity, "rationale": rationale}
        return list(kept.values())

    def segment(self, raw: dict, number: int) -> dict:
        raw = _present(raw, "segment")
        out = {k: raw.get(k) or "" for k in ("segment_id", "title", "quote", "full_text")}
        out["segment_id"] = out["segment_id"] or f"S{number:03d}"
        out["codes"] = self.codes(raw.get("codes"), out["segment_id"])
        if isinstance(raw.get("review"), dict):
            r = _present(raw["review"], "review")
            history = [{"time": "", "action": "", "detail": "", "reviewer": ""} | _present(e, "event") for e in r.get("history") or [] if isinstance(e, dict)]
            out["review"] = {
                "status": EARLIER_STATUS.get(r.get("status"), r.get("status")) or "pending", "source": EARLIER_SOURCE.get(r.get("source"), r.get("source")) or "ai", "original_codes": list(r.get("original_codes") or []),
                "original_title": r.get("original_title") or "", "original_quote": r.get("original_quote") or "", "history": history}
        return out

    def oldest(self, raw: dict) -> list[dict]:
        """Segments of the oldest shape: dimension -> polarity -> passages; passages with one full text are one segment."""
        found: dict[str, dict] = {}
        for old, dimension in EARLIER_DIMENSIONS.items():
            for polarity in self.fw.polarities if isinstance(raw.get(old), dict) and dimension in self.spellings.values() else ():
                for q in raw[old].get(polarity) or []:
                    if isinstance(q, dict):
                        q = _present(q, "segment")
                        full = str(q.get("full_text") or q.get("quote") or "").strip()
                        s = found.setdefault(full or f"\0{len(found)}", {"segment_id": f"S{len(found) + 1:03d}", "title": q.get("title") or "", "quote": q.get("quote") or "", "full_text": full, "codes": []})
                        s["codes"].append({"dimension": dimension, "polarity": polarity, "rationale": "migrated from v1"})
        return list(found.values())

    def record(self, raw: dict) -> dict:
        """The record in the present shape. Segments without codes are left out unless a person added them or their review has a history."""
        old = raw if not any(k in raw for k in ("segments", "編碼段落")) and any(k in raw for k in EARLIER_DIMENSIONS) else None
        raw = _present(raw, "record")
        listed = lambda k: [self.segment(s, i) for i, s in enumerate(raw.get(k) if isinstance(raw.get(k), list) else [], 1) if isinstance(s, dict)]
        segments = self.oldest(old) if old else listed("segments")
        kept = [s for s in segments if s["codes"] or s.get("review", {}).get("source") == "human" or s.get("review", {}).get("history")]
        out = {"respondent": raw.get("respondent") or "unknown", "descriptors": self.descriptors(raw.get("descriptors")), "segments": kept, "deleted_segments": listed("deleted_segments"), "summary": raw.get("summary") or ""}
        out |= {k: raw[k] for k in ("transcript", "transcript_file", "_source", "_file") if raw.get(k)}
        return out | {"_meta": (raw.get("_meta") if isinstance(raw.get("_meta"), dict) else {}) | {"schema_version": SCHEMA_VERSION}}

    def descriptors(self, raw: object) -> dict:
        """Allowed values; unspecified for blank ones, other for what is not allowed; without a list of descriptors all as they are."""
        raw = raw if isinstance(raw, dict) else {}
        if not self.fw.descriptors:
            return {k: v or UNSPECIFIED for k, v in raw.items()}
        clean = lambda v, allowed: UNSPECIFIED if not str(v or "").strip() else str(v).strip().lower() if str(v).strip().lower() in (*allowed, UNSPECIFIED) else OTHER
        return {k: clean(raw.get(k), allowed) for k, allowed in self.fw.descriptors} | ({"descriptor_basis": raw["descriptor_basis"]} if raw.get("descriptor_basis") else {})


def migrate_records(df: DataFrame, fw: Framework, payload: str = "payload") -> DataFrame:
    """Adds ``record`` (JSON of the present shape), ``dropped`` (codes and why), ``mismatch`` (the record names another framework) and ``error``.

    ``payload`` is the JSON text of one record. Text that is no JSON object gives a null
    record and an error. Migrating again changes nothing.
    """
    schema = "record string, dropped array<struct<segment_id:string,reason:string,dimension:string,polarity:string,rationale:string>>, mismatch boolean, error string"

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for text in s:
            status, raw = parse_payload(text)
            if status != "ok" or not isinstance(raw, dict):
                out.append((None, [], None, status if status != "ok" else "no object"))
                continue
            migration = RecordMigration(fw)
            record = migration.record(raw)
            named = record["_meta"].get("framework_id")
            dropped = [{k: None if v is None else str(v) for k, v in d.items()} for d in migration.dropped]
            out.append((json.dumps(record, ensure_ascii=False), dropped, bool(named) and named != fw.id, None))
        return pd.DataFrame(out, columns=["record", "dropped", "mismatch", "error"])

    return df.withColumn("__m", run(F.col(payload))).select("*", "__m.*").drop("__m")
