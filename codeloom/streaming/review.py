"""Review events as a stream: live state per segment and windowed counts of actions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.review import fold

_OUT = "record_id bigint, segment_id string, status string, codes array<string>, alive boolean, events bigint, updated timestamp"
_STATE = "state string, pending string, updated bigint"
_TIME = "time"


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))


def live_state(events: DataFrame, watermark: str = "1 hour", keep_hours: float = 24.0) -> DataFrame:
    """Streaming state per (record_id, segment_id), a row per change.

    Events that arrive out of order inside the watermark are applied in the order of their
    time: those the watermark has not passed yet wait in the state and are replayed on top
    of it for the result. Later ones are dropped. The state of a segment is given up when the
    watermark is ``keep_hours`` beyond its last event; an event after that starts anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, pending, updated = state.get if state.exists else ("null", "[]", 0)
        current, waiting = json.loads(held), json.loads(pending)
        passed = state.getCurrentWatermarkMs()
        for pdf in () if state.hasTimedOut else frames:
            for e in pdf.to_dict("records"):
                at = int(e[_TIME].timestamp() * 1000)
                if at >= passed:
                    waiting.append(json.loads(_text({**{k: v for k, v in e.items() if k != _TIME}, "at": at})))
        waiting.sort(key=lambda e: (e["at"], e.get("seq") or 0))
        final = [e for e in waiting if e["at"] < passed]
        waiting = waiting[len(final) :]
        for e in final:
            current, updated = fold(current, e), e["at"]
        last = waiting[-1]["at"] if waiting else updated
        end = last + int(keep_hours * 3_600_000)
        if state.hasTimedOut and not waiting and passed >= end:
            state.remove()
            return
        state.update((_text(current), _text(waiting), updated))
        state.setTimeoutTimestamp(max(passed + 1, waiting[0]["at"] + 1 if waiting else end))
        shown = current
        for e in waiting:
            shown = fold(shown, e)
        if shown is not None and not state.hasTimedOut:
            yield pd.DataFrame([{"record_id": key[0], "segment_id": key[1], "status": shown["status"], "codes": shown["codes"], "alive": shown["alive"], "events": shown["events"], "updated": pd.Timestamp(last, unit="ms")}])

    return events.withWatermark(_TIME, watermark).groupBy("record_id", "segment_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def action_counts(events: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Counts of actions per event-time window; late events beyond the watermark are dropped. Works on batch frames too."""
    e = events.withWatermark("time", watermark) if events.isStreaming else events
    return e.groupBy(F.window("time", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")
