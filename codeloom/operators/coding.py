"""Coding transcripts window by window, merging windows, and judging what came out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.distributed import running
from codeloom.functions.segmenting import OVERLAP, WINDOW, windows
from codeloom.functions.text import is_placeholder
from codeloom.operators.cooccur import MERGE_ACTION

#: Fixed values of the yield report.
LOW_YIELD, LEAST_CHARS, DIMENSION_CHARS, LEAST_INNER = 3.0, 2000, 5000, 10
_DROP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Letters and digits only, lower case."""
    return _DROP.sub("", text or "").lower()


class _Merging:
    """Segments kept so far; those of the window at hand by text, those of the window before in order."""

    def __init__(self) -> None:
        self.kept: list[dict] = []
        self.here: dict[str, int] = {}
        self.before: dict[int, str] = {}

    def next_window(self) -> None:
        self.before, self.here = {at: text for text, at in self.here.items()}, {}

    def repeated(self, text: str, shared: str | None) -> int | None:
        """Place of the kept segment that ``text`` repeats: one of the window before that holds it or is
        held by it (the inner text at least 10 characters unless both are equal, and inside the shared
        text where that is known), else the same text of this window."""
        for at, old in self.before.items():
            inner, outer = (text, old) if len(text) <= len(old) else (old, text)
            if (text == old or len(inner) >= LEAST_INNER and inner in outer) and (shared is None or shared and inner in shared):
                return at
        return self.here.get(text)

    def add(self, segment: dict, text: str, shared: str | None) -> None:
        at = self.repeated(text, shared)
        if at is None:
            self.here[text] = len(self.kept)
            self.kept.append({**segment, "codes": list(segment.get("codes") or []), "history": list(segment.get("history") or [])})
            return
        old = self.kept[at]
        had = {_code_name(c) for c in old["codes"]}
        united = {_triple(c): c for c in reversed([*old["codes"], *(segment.get("codes") or [])])}
        old["codes"] = list(old["codes"]) + [c for t, c in reversed(united.items()) if t not in {_triple(x) for x in old["codes"]}]
        if new := sorted({_code_name(c) for c in old["codes"]} - had):
            old["history"].append({"time": "", "action": MERGE_ACTION, "detail": "codes from another excerpt: " + ", ".join(new), "reviewer": ""})
        if len(segment.get("quote") or "") > len(old.get("quote") or "") and at in self.before:
            self.before[at] = text
        old |= {f: max(old.get(f) or "", segment.get(f) or "", key=len) for f in ("full_text", "quote")}


def _triple(c: dict) -> tuple:
    return c.get("dimension"), c.get("polarity"), (c.get("rationale") or "").strip()


def _code_name(c: dict) -> str:
    return "-".join(filter(None, (c.get("dimension"), c.get("polarity"))))


def merge_windows(groups: list[list[dict]], overlaps: list[str] | None = None) -> list[dict]:
    """Segments of all windows in order, repeats of the shared text merged.

    A segment: quote, full_text, codes (list of dicts with dimension, polarity, rationale).
    Only neighbouring windows share text (see :class:`_Merging`). Of a repeat the codes are
    united (a triple counts once), the longer texts are kept, and codes that came in are noted
    in the history. Segments without a quote are dropped.
    """
    merging = _Merging()
    for group, overlap in zip(groups, overlaps + [""] * len(groups) if overlaps is not None else [None] * len(groups)):
        shared = None if overlap is None else normal(overlap)
        for segment in group or []:
            if text := normal(segment.get("quote")):
                merging.add(segment, text, shared)
        merging.next_window()
    return [{**s, "segment_id": f"S{i:03d}"} for i, s in enumerate(merging.kept, 1)]


_SEGMENT = "segment_id string, title string, quote string, full_text string, codes array<struct<dimension:string,polarity:string,rationale:string>>, history array<struct<time:string,action:string,detail:string,reviewer:string>>"


def merge_segments(rows: DataFrame, key: str) -> DataFrame:
    """Merged segments per document from (key, chunk, seg_pos, title, quote, full_text, codes, overlap_text).

    The first repeat wins and texts grow, so the order within a document matters; a group is
    one document's segments.
    """
    kind = rows.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "seg_pos"], kind="stable")
        last = int(pdf["chunk"].max())
        groups: list[list[dict]] = [[] for _ in range(last + 1)]
        shared = [""] * (last + 1)
        for r in pdf.to_dict("records"):
            groups[int(r["chunk"])].append({"title": r["title"], "quote": r["quote"], "full_text": r["full_text"], "codes": [dict(c) for c in (r["codes"] if r["codes"] is not None else []) if c is not None]})
            shared[int(r["chunk"])] = r["overlap_text"] or ""
        merged = merge_windows(groups, shared)
        return pd.DataFrame([{key: pdf[key].iloc[0], **{c: m.get(c) for c in ("segment_id", "title", "quote", "full_text", "codes", "history")}} for m in merged], columns=[key, "segment_id", "title", "quote", "full_text", "codes", "history"])

    return rows.groupBy(key).applyInPandas(one, f"`{key}` {kind}, {_SEGMENT}")


class FatalCodingError(RuntimeError):
    """An error after which going on with other windows makes no sense."""


def code_windows(docs: DataFrame, key: str, coder: Callable[[str, int], list[dict]], text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Answers of ``coder(text, chunk)`` per window: (key, chunk, overlap_text, answer JSON, error).

    A window that fails keeps its row with the error; FatalCodingError ends the job.
    """
    plan = windows(docs, [key], text, window, overlap).select(key, "chunk", "text", "overlap_text")
    kind = plan.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers, errors = [], []
            for t, c in zip(pdf["text"], pdf["chunk"]):
                try:
                    answers.append(json.dumps(coder(t, int(c)), ensure_ascii=False))
                    errors.append(None)
                except FatalCodingError as e:
                    raise FatalCodingError(f"window {c}: {e}") from e
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "chunk": pdf["chunk"], "overlap_text": pdf["overlap_text"], "answer": answers, "error": errors})

    return plan.mapInPandas(run, f"`{key}` {kind}, chunk int, overlap_text string, answer string, error string")


def code_transcripts(docs: DataFrame, key: str, coder: Callable[[str, int], list[dict]], text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Merged segments of all documents, coded window by window."""
    answers = code_windows(docs, key, coder, text, window, overlap).filter("error is null")
    shape = "array<struct<title:string,quote:string,full_text:string,codes:array<struct<dimension:string,polarity:string,rationale:string>>>>"
    rows = answers.select(key, "chunk", "overlap_text", F.posexplode(F.from_json("answer", shape)).alias("seg_pos", "s")).select(key, "chunk", "seg_pos", "s.*", "overlap_text")
    return merge_segments(rows, key)


def yield_report(docs: DataFrame, segments: DataFrame, key: str, dimensions: list[str] | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: characters, segments, per 10,000 characters, and flags.

    low_yield (under 3 per 10,000 from 2,000 characters on), one_per_dimension (as many
    segments as dimensions, one each), missing_dimension (a dimension never used from 5,000
    characters on). ``segments``: key, dimensions (array). Documents without segments stay.
    ``dimensions`` are those of all documents, or a column of ``docs`` with those of each; ``keep`` are further columns of ``docs`` to keep.
    """
    agg = segments.groupBy(key).agg(F.count("*").alias("segments"), F.collect_list(F.array_join(F.array_sort(F.array_distinct("dimensions")), "/")).alias("sets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dimensions")))).alias("used"))
    wanted = dimensions if isinstance(dimensions, Column) else F.array(*map(F.lit, dimensions))
    out = docs.select(*keep, key, F.coalesce(F.length("text"), F.lit(0)).alias("chars"), wanted.alias("wanted")).join(agg, key, "left").fillna(0, ["segments"])
    per = F.try_divide(F.col("segments") * F.lit(10000.0), F.col("chars").cast("double"))
    one_each = (F.col("segments") == F.size("wanted")) & (F.size(F.array_distinct("sets")) == F.col("segments")) & F.forall("sets", lambda s: ~s.contains("/"))
    missing = F.array_except("wanted", F.coalesce("used", F.array().cast("array<string>")))
    flags = F.array_compact(F.array(
        F.when((F.col("chars") >= LEAST_CHARS) & (per < LOW_YIELD), "low_yield"), F.when(F.coalesce(one_each, F.lit(False)), "one_per_dimension"),
        F.when((F.col("chars") >= DIMENSION_CHARS) & (F.size(missing) > 0), "missing_dimension")))
    return out.select(*keep, key, "chars", "segments", per.alias("per_10k"), F.array_join(flags, "/").alias("flags"))


def merge_respondent(names: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent name per key that is no placeholder; ties go to the earliest (``ord``); unknown where there is none."""
    counted = names.groupBy(*keys, F.when(~is_placeholder(F.col("name")), F.trim("name")).alias("name")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("n"), "first")))
    return counted.groupBy(*keys).agg(F.coalesce(best, F.lit("unknown")).alias("name"))


def merge_descriptors(parts: DataFrame, keys: list[str]) -> DataFrame:
    """First value per descriptor that is neither null nor unspecified, by ``ord``; unspecified where there is none."""
    good = F.when(F.col("value").isNotNull() & (F.col("value") != "unspecified"), F.col("value"))
    return parts.groupBy(*keys, "descriptor").agg(F.coalesce(F.min_by(good, F.when(good.isNotNull(), F.col("ord"))), F.lit("unspecified")).alias("value"))


def already_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not in ``done``."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def verify_quotes(quotes: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, quote_id, verbatim): whether the normalised quote is contained in its transcript; null for blank quotes or no transcript."""
    n = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    t = transcripts.select(key, n(F.col("text")).alias("t"))
    return quotes.join(t, key, "left").select(key, "quote_id", F.when(n(F.col("quote")) != "", F.contains("t", n(F.col("quote")))).alias("verbatim"))


def number(df: DataFrame, order: list[str], pattern: str, name: str) -> DataFrame:
    """Ids like G0001 in the given order."""
    return running(df, order, number="__no").withColumn(name, F.format_string(pattern, F.col("__no"))).drop("__no")


def attach_transcripts(records: DataFrame, uploads: DataFrame, key: str = "transcript_file") -> DataFrame:
    """Own transcript first, else the uploaded one of the same file; ``missing`` where neither exists."""
    up = uploads.groupBy(key).agg(F.min("text").alias("__up"))
    out = records.join(up, key, "left").withColumn("transcript", F.coalesce(F.when(F.trim("transcript") != "", F.col("transcript")), "__up")).drop("__up")
    return out.withColumn("missing", F.col("transcript").isNull())
