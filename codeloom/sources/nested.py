"""Nested JSON payloads to flat, linked tables by interval labels.

Every node of a payload gets a pre-order and a post-order number in one depth-first
traversal. Node ``a`` contains node ``b`` of the same payload exactly if
``a.pre < b.pre and a.post > b.post``; the typed tables (records, windows, segments,
codes) are linked by that containment alone, so no chain of parent keys is needed and
any two levels can be joined directly.

Defined results
---------------
* A null, empty, cut-off or non-JSON payload gives no nodes; ``payload_status`` names it.
* Payloads may nest to any depth: parsing and traversal keep their own stacks.
* Payloads are told apart by key and content: rows with a null or a repeated key are not
  linked with each other, rows that repeat both give their nodes once each.
* A byte-order mark before the JSON is dropped. Text that itself holds complete JSON is
  read as that JSON wherever a structural part (payload, record, list, segment, code) is
  expected.
* Null entries of an array keep their position but are no rows. A lone object where an
  array is expected counts as the only entry (position 0). An object keyed by ids counts
  as an array in key order, its keys being the ids.
* Values that are absent or null give ``''`` as id or item; other scalars give their JSON
  text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_LISTS = ("segments", "open_segments", "deleted_segments")
CODE_FIELDS = {"segments": ("codes", "open_codes"), "open_segments": ("open_codes", "codes"), "deleted_segments": ("codes", "open_codes")}
RECORD_FIELDS = (*SEGMENT_LISTS, "windows", "respondent", "descriptors", "_meta")
SEGMENT_FIELDS = ("segment_id", "title", "quote", "full_text", "codes", "open_codes", "review")
CODE_ITEM_FIELDS = ("dimension", "code_id", "label", "polarity", "rationale")

NODE_SCHEMA = "kind string, pre bigint, post bigint, pos int, list_name string, ident string, attrs map<string,string>"


_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def _parse_deep(s: str) -> object:
    """JSON nested deeper than the usual parser can follow; ValueError where it is none."""
    top: list = []
    # Open containers with, for objects, the key that waits for its value.
    stack: list[tuple[object, list]] = [(top, [])]
    at, fresh = _SPACE.match(s, 0).end(), True
    while True:
        box, key = stack[-1]
        c = s[at : at + 1]
        if c in ("]", "}") and len(stack) > 1 and (c == "]") == isinstance(box, list) and not key:
            stack.pop()
            at, fresh = at + 1, False
        elif not fresh:
            if len(stack) == 1:
                break
            if c != ",":
                raise ValueError(at)
            at, fresh = _SPACE.match(s, at + 1).end(), True
            if s[at : at + 1] in ("]", "}"):
                raise ValueError(at)
            continue
        elif isinstance(box, dict) and not key:
            if c != '"':
                raise ValueError(at)
            name, at = scanstring(s, at + 1)
            at = _SPACE.match(s, at).end()
            if s[at : at + 1] != ":":
                raise ValueError(at)
            key.append(name)
            at = _SPACE.match(s, at + 1).end()
            continue
        else:
            if c == '"':
                value, at = scanstring(s, at + 1)
            elif c in ("[", "{") and c:
                value, at = ([] if c == "[" else {}), at + 1
            elif m := _ATOM.match(s, at):
                value, at = json.loads(m.group()), m.end()
            else:
                raise ValueError(at)
            if isinstance(box, list):
                box.append(value)
            else:
                box[key.pop()] = value
            fresh = isinstance(value, (list, dict))
            if fresh:
                stack.append((value, []))
        at = _SPACE.match(s, at).end()
    if at < len(s):
        raise ValueError(at)
    return top[0]


def _parse(s: str) -> object:
    try:
        return json.loads(s)
    except RecursionError:
        return _parse_deep(s)


def _dump(value: object) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        literal, v = todo.pop()
        if literal:
            out.append(v)
        elif isinstance(v, dict):
            todo.append((True, "}"))
            for i, (k, x) in reversed(list(enumerate(v.items()))):
                todo += [(False, x), (True, (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            todo.append((True, "{"))
        elif isinstance(v, list):
            todo.append((True, "]"))
            for i, x in reversed(list(enumerate(v))):
                todo += [(False, x), (True, ", " if i else "")]
            todo.append((True, "["))
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _text(value: object) -> str:
    """JSON scalar or container as text; null is the empty string."""
    if value is None:
        return ""
    return value if isinstance(value, str) else _dump(value)


def _opened(value: object) -> object:
    """Strings that hold a complete JSON object or array are replaced by it, repeatedly."""
    while isinstance(value, str):
        s = value.strip().lstrip("\ufeff").strip()
        if s[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = _parse(s)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def parse_payload(payload: str | None) -> tuple[str, object]:
    """(status, value); status is ok, null, empty or damaged."""
    if payload is None:
        return "null", None
    s = payload.lstrip("\ufeff").strip()
    if not s:
        return "empty", None
    try:
        value = _opened(_parse(s))
    except ValueError:
        return "damaged", None
    return ("ok", value) if isinstance(value, (dict, list)) else ("damaged", None)


class _Labeller:
    """One depth-first traversal; keeps the typed nodes with their interval labels."""

    def __init__(self, attributes: bool) -> None:
        self.pre = self.post = 0
        self.rows: list[tuple] = []
        self.attributes = attributes

    def _skip(self, value: object) -> None:
        """Number the nodes of an untyped subtree."""
        stack, n = [value], 0
        while stack:
            v = stack.pop()
            n += 1
            if isinstance(v, dict):
                stack.extend(v.values())
            elif isinstance(v, list):
                stack.extend(v)
        self.pre += n
        self.post += n

    def _enter(self) -> int:
        self.pre += 1
        return self.pre

    def _leave(self, kind: str | None, pre: int, pos: int = 0, list_name: str = "", ident: str = "", attrs: dict | None = None) -> None:
        self.post += 1
        if kind:
            kept = {k: _text(v) for k, v in attrs.items() if not isinstance(v, (dict, list))} if attrs and self.attributes else None
            self.rows.append((kind, pre, self.post, pos, list_name, ident, kept))

    def container(self, value: object, pos: int) -> None:
        """Envelopes and arrays around records, to any depth."""
        todo: list[tuple[object, int, int]] = [(value, pos, 0)]
        while todo:
            v, at, left = todo.pop()
            if left:
                self._leave(None, left)
                continue
            v = _opened(v)
            if isinstance(v, dict) and any(k in v for k in RECORD_FIELDS):
                self.record(v, at)
            elif isinstance(v, (dict, list)):
                todo.append((None, at, self._enter()))
                inner = list(enumerate(v)) if isinstance(v, list) else [(at, x) for x in v.values()]
                todo.extend((x, i, 0) for i, x in reversed(inner))
            else:
                self._skip(v)

    def record(self, record: dict, pos: int) -> None:
        pre = self._enter()
        for k, v in record.items():
            if k in SEGMENT_LISTS:
                self.segments(k, v)
            elif k == "windows":
                self.windows(v)
            else:
                self._skip(v)
        self._leave("record", pre, pos, attrs=record)

    def windows(self, value: object) -> None:
        value, pre = _opened(value), self._enter()
        if isinstance(value, dict):
            value = [value] if any(k in value for k in SEGMENT_LISTS) else list(value.values())
        for i, w in enumerate(value if isinstance(value, list) else []):
            w = _opened(w)
            if not isinstance(w, dict):
                self._skip(w)
                continue
            at = self._enter()
            for k, v in w.items():
                if k in SEGMENT_LISTS:
                    self.segments(k, v)
                else:
                    self._skip(v)
            self._leave("window", at, i, attrs=w)
        self._leave(None, pre)

    def segments(self, name: str, value: object) -> None:
        value, pre = _opened(value), self._enter()
        if isinstance(value, dict):
            lone = any(k in value for k in SEGMENT_FIELDS)
            entries = [(None, value)] if lone else list(value.items())
        else:
            entries = [(None, v) for v in value] if isinstance(value, list) else []
        for i, (key, seg) in enumerate(entries):
            seg = _opened(seg)
            if isinstance(seg, dict):
                self.segment(name, i, key, seg)
            else:
                self._skip(seg)
        self._leave(None, pre)

    def segment(self, name: str, pos: int, key: str | None, seg: dict) -> None:
        pre = self._enter()
        first, second = CODE_FIELDS[name]
        field = first if first in seg or second not in seg else second
        for k, v in seg.items():
            if k == field:
                self.codes(name, v)
            else:
                self._skip(v)
        self._leave("segment", pre, pos, name, key if key is not None else _text(seg.get("segment_id")), seg)

    def codes(self, name: str, value: object) -> None:
        value, pre = _opened(value), self._enter()
        if isinstance(value, dict):
            keyed = value and all(isinstance(v, dict) for v in value.values()) and not any(k in value for k in CODE_ITEM_FIELDS)
            entries = list(value.values()) if keyed else [value]
        elif isinstance(value, list):
            entries = value
        else:
            entries = [value] if isinstance(value, str) and value.strip() else []
        for i, code in enumerate(entries):
            code = _opened(code)
            at = self._enter()
            if isinstance(code, dict):
                for v in code.values():
                    self._skip(v)
                item = code.get("code_id") if name == "open_segments" or "dimension" not in code else code.get("dimension")
                self._leave("code", at, i, name, _text(item), code)
            elif code is None:
                self._leave(None, at)
            else:
                self._leave("code", at, i, name, _text(code))
        self._leave(None, pre)


def label_nodes(value: object, attributes: bool = False) -> list[tuple]:
    """Typed nodes of one parsed payload as (kind, pre, post, pos, list_name, ident, attrs)."""
    walk = _Labeller(attributes)
    walk.container(value, 0)
    return walk.rows


def payload_status(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` with ``status``: ok, null, empty or damaged."""

    @F.pandas_udf("string")
    def status(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: parse_payload(x)[0])

    return df.withColumn("status", status(F.col(payload)))


def node_table(df: DataFrame, key: str = "raw_id", payload: str = "payload", attributes: bool = False) -> DataFrame:
    """One row per record, window, segment and code node of every readable payload.

    Columns: ``key``, ``payload_hash`` (tells payloads of one key apart) and
    ``NODE_SCHEMA``. ``attributes`` adds the node's scalar fields as a map; leave it off
    where only structure is needed, since the texts are then shuffled with the labels.
    """
    text = F.col(payload).cast("string")
    slim = df.select(F.col(key), F.xxhash64(text).alias("payload_hash"), text.alias("__payload"))
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            take: list[int] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                status, value = parse_payload(text)
                if status != "ok":
                    continue
                rows = label_nodes(value, attributes)
                take.extend([i] * len(rows))
                for row in rows:
                    for col, v in zip(out, row):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            cols = [batch.column(k).take(pa.array(take, pa.int64())) for k in (0, 1)]
            cols += [pa.array([list(m.items()) if isinstance(m, dict) else m for m in c] if t == types[6] else c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "payload_hash", "kind", "pre", "post", "pos", "list_name", "ident", "attrs"])

    return slim.mapInArrow(run, f"`{key}` {kind}, payload_hash bigint, {NODE_SCHEMA}")


def link_nodes(nodes: DataFrame, key: str = "raw_id") -> DataFrame:
    """Add to every node its containing record, window and segment, by interval containment.

    Nodes of one kind never nest in each other, so the only node of a kind that can
    contain ``b`` is the last one before ``b`` in pre-order; its post-order number decides.
    One sort per payload replaces a range join. Adds ``record``, ``window`` and
    ``segment``: structs (pre, post, pos, list_name, ident), null where none contains.
    """
    order = Window.partitionBy(key, "payload_hash").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    for kind in ("record", "window", "segment"):
        node = F.struct("pre", "post", "pos", "list_name", "ident")
        nodes = nodes.withColumn(f"__{kind}", F.last(F.when(F.col("kind") == kind, node), ignorenulls=True).over(order))
    for kind in ("record", "window", "segment"):
        near = F.col(f"__{kind}")
        nodes = nodes.withColumn(kind, F.when(near["post"] > F.col("post"), near)).drop(f"__{kind}")
    return nodes


def record_table(linked: DataFrame, key: str = "raw_id") -> DataFrame:
    """Records: key, rec_pos, interval labels and attributes."""
    return linked.filter(F.col("kind") == "record").select(key, F.col("pos").alias("rec_pos"), "pre", "post", "attrs")


def segment_table(linked: DataFrame, key: str = "raw_id") -> DataFrame:
    """Segments with their record and window (window_pos -1: directly in the record)."""
    return linked.filter(F.col("kind") == "segment").select(
        key, F.col("record.pos").alias("rec_pos"), F.coalesce("window.pos", F.lit(-1)).alias("window_pos"), "list_name",
        F.col("pos").alias("seg_pos"), F.col("ident").alias("segment_id"), "pre", "post", "attrs",
    )


def code_table(linked: DataFrame, key: str = "raw_id") -> DataFrame:
    """Codes with their segment, window and record."""
    return linked.filter(F.col("kind") == "code").select(
        key, F.col("record.pos").alias("rec_pos"), F.coalesce("window.pos", F.lit(-1)).alias("window_pos"), "list_name",
        F.col("segment.pos").alias("seg_pos"), F.col("segment.ident").alias("segment_id"),
        F.col("pos").alias("code_pos"), F.col("ident").alias("item"), "pre", "post", "attrs",
    )
