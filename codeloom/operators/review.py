"""Review: audit trail, statistics, changes, and the state of a segment as a fold over events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.arrays import sorted_set
from codeloom.functions.distributed import running

STATUSES = ("pending", "confirmed", "modified", "added", "deleted")


def stats(segments: DataFrame) -> DataFrame:
    """One row over (list_name, status, source): AI segments and what became of them, human additions, active and pending.

    A segment of ``deleted_segments`` is deleted whatever its status says.
    """
    deleted = F.col("list_name") == "deleted_segments"
    status = F.when(deleted, "deleted").otherwise(F.coalesce("status", F.lit("pending")))
    ai = F.coalesce("source", F.lit("ai")) == "ai"
    one = lambda c: F.sum(c.cast("int"))
    out = segments.agg(
        F.coalesce(one(ai), F.lit(0)).alias("ai"), F.coalesce(one(ai & status.isin("confirmed", "modified", "deleted")), F.lit(0)).alias("reviewed"), F.coalesce(one(ai & (status == "confirmed")), F.lit(0)).alias("confirmed"),
        F.coalesce(one(ai & (status == "modified")), F.lit(0)).alias("modified"), F.coalesce(one(ai & deleted), F.lit(0)).alias("deleted"), F.coalesce(one(~ai & ~deleted), F.lit(0)).alias("human_added"),
        F.coalesce(one(~ai & deleted), F.lit(0)).alias("human_deleted"), F.coalesce(one(~deleted), F.lit(0)).alias("active"), F.coalesce(one(~deleted & (status == "pending")), F.lit(0)).alias("pending"))
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col("reviewed").cast("double"))
    return out.select("*", *[rate(c).alias(f"{c}_rate") for c in ("confirmed", "modified", "deleted")])


def code_changes(segments: DataFrame) -> DataFrame:
    """Per code over (original_codes, code_list): original, kept, removed, added, removal_rate, net."""
    o, n = sorted_set(F.col("original_codes")), sorted_set(F.col("code_list"))
    tag = lambda arr, kind: F.transform(arr, lambda c: F.struct(c.alias("code"), F.lit(kind).alias("kind")))
    rows = segments.select(F.explode(F.concat(tag(F.array_intersect(o, n), "kept"), tag(F.array_except(o, n), "removed"), tag(F.array_except(n, o), "added"))).alias("x")).select("x.*")
    one = lambda *k: F.sum(F.col("kind").isin(*k).cast("int"))
    out = rows.groupBy("code").agg(one("kept", "removed").alias("original"), one("kept").alias("kept"), one("removed").alias("removed"), one("added").alias("added"))
    return out.withColumn("removal_rate", F.try_divide(F.col("removed").cast("double"), F.col("original").cast("double"))).withColumn("net", F.col("added") - F.col("removed"))


def history_rows(records: DataFrame) -> DataFrame:
    """(record_id, list_name, seg_pos, segment_id, event_pos, time, action, detail, reviewer) of every review event."""
    from codeloom.operators.longtable import segments_of

    seg = segments_of(records, ("segments", "deleted_segments"))
    events = seg.select("record_id", "list_name", "seg_pos", "segment.segment_id", F.posexplode("segment.review.history").alias("event_pos", "e")).filter("e is not null")
    return events.select("record_id", "list_name", "seg_pos", "segment_id", "event_pos", F.try_to_timestamp("e.time").alias("time"), "e.action", "e.detail", "e.reviewer")


def audit_trail(events: DataFrame, last: int = 100) -> DataFrame:
    """The last events by time (a top-k report); ties by record and position."""
    return events.orderBy(F.desc_nulls_last("time"), "record_id", "list_name", "seg_pos", "event_pos").limit(last)


def changed_segments(segments: DataFrame) -> DataFrame:
    """Segments whose code set differs from the snapshot, with both as strings."""
    o, n = sorted_set(F.col("original_codes")), sorted_set(F.col("code_list"))
    return segments.filter(F.col("original_codes").isNotNull() & (o != n)).select("record_id", "seg_pos", F.array_join(o, "/").alias("before"), F.array_join(n, "/").alias("after"))


#: Review events: key columns and what an event may carry.
EVENT_SCHEMA = "record_id bigint, segment_id string, time timestamp, seq bigint, action string, codes array<string>, text string, reviewer string"
STATE_SCHEMA = "record_id bigint, segment_id string, status string, source string, codes array<string>, text string, original_codes array<string>, original_text string, alive boolean, events bigint"


def fold(state: dict | None, event: dict) -> dict:
    """One step of the review state machine.

    ``create`` starts a segment (by a human: added). The first change takes a snapshot of
    codes and text, once. Status follows from content: equal to the snapshot is confirmed,
    different is modified; a human's own segment stays added. Deleting remembers the status
    for a restore. Unknown actions and events for segments that do not exist change nothing.
    """
    codes = sorted({c for c in (event.get("codes") if event.get("codes") is not None else []) if c})
    action = event["action"]
    if action in ("create", "add"):
        if state is not None:
            return state
        human = action == "add"
        return {"status": "added" if human else "pending", "source": "human" if human else "ai", "codes": codes, "text": event.get("text"), "original_codes": None, "original_text": None, "alive": True, "before": None, "events": 1}
    if state is None:
        return state
    s = dict(state)
    s["events"] += 1
    if action == "delete" and s["alive"]:
        s.update(alive=False, before=s["status"], status="deleted")
    elif action == "restore" and not s["alive"]:
        s.update(alive=True, status=s["before"] or "pending", before=None)
    elif action in ("confirm", "update_codes", "update_text") and s["alive"]:
        if s["original_codes"] is None:
            s.update(original_codes=s["codes"], original_text=s["text"])
        if action == "update_codes":
            s["codes"] = codes
        if action == "update_text":
            s["text"] = event.get("text")
        if s["source"] == "human":
            s["status"] = "added"
        else:
            same = s["codes"] == s["original_codes"] and s["text"] == s["original_text"]
            s["status"] = "confirmed" if same else "modified"
    return s


def replay(events: DataFrame) -> DataFrame:
    """State of every segment after its events in order of (time, seq).

    Sorted within partitions and streamed, so a segment with very many events is folded
    without being held in memory.
    """
    cols = ["record_id", "segment_id", "time", "seq", "action", "codes", "text", "reviewer"]
    ordered = events.select(*cols).repartition("record_id", "segment_id").sortWithinPartitions("record_id", "segment_id", F.asc_nulls_first("time"), "seq")

    def run(frames):  # noqa: ANN001, ANN202
        key, state, out = None, None, []

        def row() -> dict:
            return {"record_id": key[0], "segment_id": key[1]} | {k: state[k] for k in ("status", "source", "codes", "text", "original_codes", "original_text", "alive", "events")}

        for pdf in frames:
            for e in pdf.to_dict("records"):
                k = (None if pd.isna(e["record_id"]) else int(e["record_id"]), e["segment_id"])
                if k != key:
                    if state is not None:
                        out.append(row())
                    key, state = k, None
                state = fold(state, e)
            if len(out) > 10_000:
                yield pd.DataFrame(out)
                out = []
        if state is not None:
            out.append(row())
        if out:
            yield pd.DataFrame(out)

    return ordered.mapInPandas(run, STATE_SCHEMA)


def saturation(steps: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """Running number ``n`` and total ``cumulative`` of newly created codes over windows in order, per ``partition``."""
    return running(steps, order, partition, total="created", number="n")
