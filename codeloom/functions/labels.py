"""Column expressions that bring dimensions, polarities and open-code labels to their clean spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frameworks are configuration. More rows than this are refused rather than collected.
MAX_FRAMEWORK_ROWS = 10_000

_SEPARATORS = r"[(（)）\-—/|:：,，、]"


def norm_key(c: Column) -> Column:
    """Case, outer blanks and the choice between blank and underscore do not matter."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s_]+", " "))), "^ +| +$", "")


def framework_rows(frameworks: DataFrame) -> list:
    """The framework table on the driver; refuses more than MAX_FRAMEWORK_ROWS rows."""
    rows = frameworks.select("framework_id", "dim_ord", "dimension", "short_code", "label_en", "label_zh", "polarity_values").limit(MAX_FRAMEWORK_ROWS + 1).collect()
    if len(rows) > MAX_FRAMEWORK_ROWS:
        raise ValueError(f"more than {MAX_FRAMEWORK_ROWS} framework rows")
    return sorted((r for r in rows if r.framework_id is not None and r.dimension is not None), key=lambda r: (r.framework_id, r.dim_ord or 0))


def _key(s: str) -> str:
    return " ".join(s.replace("_", " ").lower().split())


def dimension_of(rows: list, framework: Column, raw: Column) -> Column:
    """Clean dimension of ``raw`` in ``framework``, or null where it names none.

    Accepted are the dimension, its short code and its labels in any case; failing that,
    the parts of a decorated spelling (``KNW: knowledge``, ``Payoff (PAY)``) if together
    they name exactly one dimension.
    """
    aliases: dict[str, dict[str, str]] = {}
    for r in rows:
        own = aliases.setdefault(r.framework_id, {})
        for spelling in (r.dimension, r.short_code, r.label_en, r.label_zh):
            if spelling and _key(spelling):
                own.setdefault(_key(spelling), r.dimension)
    result = F.lit(None).cast("string")
    for fw, own in aliases.items():
        known = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
        parts = F.transform(F.split(raw, _SEPARATORS), lambda p: F.try_element_at(known, norm_key(p)))
        found = F.array_distinct(F.filter(parts, lambda d: d.isNotNull()))
        one = F.when(F.size(found) == 1, found[0])
        result = F.when(framework == fw, F.coalesce(F.try_element_at(known, norm_key(raw)), one)).otherwise(result)
    return F.when(raw.isNotNull(), result)


def polarity_of(rows: list, framework: Column, raw: Column) -> Column:
    """Clean polarity: '' where the framework has none, null where ``raw`` is none of its values."""
    poles = {r.framework_id: list(r.polarity_values or []) for r in rows}
    up, result = F.upper(F.trim(raw)), F.lit(None).cast("string")
    for fw, values in poles.items():
        clean = F.when(up.isin([v.upper() for v in values]), up) if values else F.lit("")
        result = F.when(framework == fw, clean).otherwise(result)
    return result


def clean_label(raw: Column) -> Column:
    """An open-code label without the decoration models and people add to it.

    Drops leading ``[9x]``, ``[NEW CODE]``, ``NEW:``, bullets and quotes, a definition
    after a dash that stands between blanks, closing punctuation and repeated blanks. A
    label of decoration only becomes ''.
    """
    c = F.regexp_replace(raw, r"(?U)\s+", " ")
    c = F.regexp_replace(c, r"(?i)^(\s*(\[\s*\d+\s*[x×]\s*\]|\[\s*new( code)?\s*\]|【[^】]*】|new( code)?\s*[:：]|[-*•#>]+ ))+", "")
    c = F.regexp_replace(c, r"\s[—–-]+\s.*$", "")
    c = F.regexp_replace(c, r"——.*$", "")
    return F.regexp_replace(c, r"^[\s\"'“”‘’«»「『*_`]+|[\s\"'“”‘’«»」』*_`.。．!！?？;；:：,，、…]+$", "")


def label_key(raw: Column) -> Column:
    """Join key of a label: cleaned and lower case."""
    return F.lower(clean_label(raw))


def clean_text(raw: str | None) -> str:
    """:func:`clean_label` of one label outside of Spark; null gives ''."""
    t = re.sub(r"\s+", " ", raw or "")
    t = re.sub(r"(?i)^(\s*(\[\s*\d+\s*[x×]\s*\]|\[\s*new( code)?\s*\]|【[^】]*】|new( code)?\s*[:：]|[-*•#>]+ ))+", "", t)
    t = re.sub(r"——.*$", "", re.sub(r"\s[—–-]+\s.*$", "", t))
    return re.sub(r"^[\s\"'“”‘’«»「『*_`]+|[\s\"'“”‘’«»」』*_`.。．!！?？;；:：,，、…]+$", "", t)
