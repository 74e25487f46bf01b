"""Lenient JSON: what models answer, as far as it can be read."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING_OR_COMMA = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)
_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S | re.I)


def first_balanced(text: str) -> str | None:
    """The first complete object or array, strings and escapes respected."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    stack, quoted, skip = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start : i + 1]
    return None


def _line_breaks(text: str) -> str:
    """Raw control characters inside strings, escaped."""
    out, quoted, skip = [], False, False
    for c in text:
        if quoted and not skip and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
            continue
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        out.append(c)
    return "".join(out)


def _no_trailing_commas(text: str) -> str:
    """Commas before a closing bracket dropped; strings stay as they are."""
    return _STRING_OR_COMMA.sub(lambda m: m["string"] or "", text)


def repair(text: str | None) -> str | None:
    """Normalised JSON of an answer, or null: tried as it is, fenced, first balanced part, with raw line breaks escaped and trailing commas dropped."""
    if not text or not text.strip():
        return None
    text = text.lstrip("﻿")
    fenced = _FENCE.search(text)
    tries = [text, *([fenced.group(1)] if fenced else [])]
    tries += [b for t in tries[::-1] if (b := first_balanced(t))]
    for t in tries:
        for fix in (t, _line_breaks(t), _no_trailing_commas(_line_breaks(t))):
            try:
                value = json.loads(fix)
            except (ValueError, RecursionError):
                continue
            if isinstance(value, (dict, list)):
                return json.dumps(value, ensure_ascii=False)
    return None


def repaired(c: Column) -> Column:
    """Column of answers to normalised JSON text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repair)

    return run(c)
