"""Public hearings: turns by upper-case labels, witnesses, question-answer pairs, sector rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.segmenting import _flat_map

_TURN = re.compile(r"^\s*(?:The\s+)?((?:Mr|Mrs|Ms|Dr|Mx)\.?\s[^.\n]{1,50}|(?:Chair(?:man|woman|person)?|CHAIR(?:MAN|WOMAN|PERSON)?|Senator|Representative|WITNESS|MEMBER)\b[^.\n]{0,50}|[A-Z][A-Z '\-]{2,40})\.\s+(.*)$")
_CHAIR = re.compile(r"(?i)chair|senator|representative|member")
#: Ordered rules from affiliation words to sector; the first that matches holds.
SECTORS = (("academia", r"(?i)university|college|professor|institute of technology"), ("government", r"(?i)department|agency|bureau|federal|ministry|commission"),
           ("nonprofit", r"(?i)foundation|association|coalition|center for|alliance|union"), ("industry", r"(?i)\binc\b|\bcorp|\bllc|\bltd|company|chief executive|vice president"))


def hearing_turns(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(position, speaker, kind, text): kind is chair for members asking, witness for others; lines before the first label are left out."""
    speaker, held, n = None, [], 0
    for line in (text or "").split("\n"):
        m = _TURN.match(line)
        if m:
            if speaker and held:
                yield n, speaker, "chair" if _CHAIR.search(speaker) else "witness", " ".join(held)
                n += 1
            speaker, held = m.group(1).strip(), [m.group(2).strip()] if m.group(2).strip() else []
        elif speaker and line.strip():
            held.append(line.strip())
    if speaker and held:
        yield n, speaker, "chair" if _CHAIR.search(speaker) else "witness", " ".join(held)


def turns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per hearing turn."""
    import pyarrow as pa

    return _flat_map(docs, [key], text, "position int, speaker string, kind string, text string", ["position", "speaker", "kind", "text"], [pa.int32(), pa.string(), pa.string(), pa.string()], hearing_turns)


def question_answers(t: DataFrame, key: str = "doc_id", least: int = 1) -> DataFrame:
    """Each witness answer with the last question before it; answers shorter than ``least`` are dropped."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    q = F.last(F.when(F.col("kind") == "chair", F.col("text")), ignorenulls=True).over(w)
    return t.withColumn("question", q).filter((F.col("kind") == "witness") & (F.length("text") >= least)).select(key, "position", "speaker", "question", F.col("text").alias("answer"))


def sector(affiliation):  # noqa: ANN001, ANN201
    """Sector of an affiliation column by the first rule that matches, else other."""
    out = F.lit("other")
    for name, rule in reversed(SECTORS):
        out = F.when(affiliation.rlike(rule), name).otherwise(out)
    return F.when(affiliation.isNull(), "unspecified").otherwise(out)
