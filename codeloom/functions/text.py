"""Text expressions: normalisers, script detection, token estimate, name predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of CJK characters from which a text counts as Chinese.
CJK_SHARE = 0.15
_CJK = r"[一-鿿]"
#: Marks that one of the normalisers drops.
PUNCTUATION = r"[\s，。！？；：、,.!?;:「」『』（）()〈〉《》【】\-—…·\"'　]+"


def alnum_lower(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def drop_punctuation(c: Column) -> Column:
    """Without blanks and common marks, case kept."""
    return F.regexp_replace(c, PUNCTUATION, "")


def loose_key(c: Column) -> Column:
    """Without blanks, common marks and curly quotes, lower case."""
    return F.lower(F.regexp_replace(c, r"[\s，。！？；：、,.!?;:「」『』（）()〈〉《》【】\-—…·\"'　“”‘’]+", ""))


def script(c: Column) -> Column:
    """'zh', 'en' or 'unknown' by the share of CJK among CJK and Latin letters."""
    cjk, latin = F.regexp_count(c, F.lit(_CJK)), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = F.try_divide(cjk.cast("double"), (cjk + latin).cast("double"))
    return F.when(share.isNull(), "unknown").when(share >= CJK_SHARE, "zh").otherwise("en")


def estimate_tokens(c: Column) -> Column:
    """CJK characters plus other characters / 3.5 plus 16."""
    cjk = F.regexp_count(c, F.lit(_CJK))
    return cjk + ((F.length(c) - cjk) / F.lit(3.5)).cast("bigint") + F.lit(16)


#: Names that stand for no name, and what copied instructions contain or start with.
PLACEHOLDERS = (
    "unknown", "unspecified", "unnamed", "none", "n/a", "na", "null", "respondent", "the respondent", "interviewee", "the interviewee",
    "speaker", "the speaker", "participant", "the participant", "未指定", "不明", "未知", "受訪者", "受訪人", "無")
PLACEHOLDER_PARTS, PLACEHOLDER_STARTS = ("as named in",), ("the respondent", "the person speaking")


def is_placeholder(c: Column) -> Column:
    """Null, empty and stand-in names, quotation marks around them aside."""
    key = F.btrim(F.lower(F.trim(c)), F.lit("「」\"'"))
    found = (key == "") | key.isin(*PLACEHOLDERS)
    for x in PLACEHOLDER_PARTS:
        found = found | key.contains(x)
    for x in PLACEHOLDER_STARTS:
        found = found | key.startswith(x)
    return c.isNull() | found


def respondent_of_file(c: Column) -> Column:
    """Respondent's id from a file name: without folder and extension; unknown where nothing is left."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    stem = F.trim(F.regexp_replace(base, r"^(.*[^.].*)\.[^.]*$", "$1"))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("unknown"))


def host_class(url: Column) -> Column:
    """loopback, private, public or unknown host of an endpoint address."""
    host = F.lower(F.regexp_extract(url, r"^(?:[a-z]+://)?(?:[^@/]*@)?(\[[0-9a-fA-F:]+\]|[^:/?#]+)", 1))
    ip = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    return (
        F.when(host.isNull() | (host == ""), "unknown")
        .when(host.isin("localhost", "[::1]") | host.rlike(r"^127\."), "loopback")
        .when(ip & host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.)"), "private")
        .when(host.rlike(r"^\[f[cde]") | host.rlike(r"\.(local|lan|internal|home)$") | ~host.contains("."), "private")
        .otherwise("public")
    )


# --- Fixed values: ways of saying that a passage does not show something -------------------------
# What the respondent says is lacking is evidence; only verbs and nouns of showing are listed.
SHOWING = "show demonstrate exhibit display reflect indicate reveal evidence mention articulate".split()
FAILING = [*"show demonstrate exhibit display reflect indicate reveal evidence mention acknowledge articulate".split()]
TRACES = "evidence indication sign mention trace".split()
SHOWN = "shown demonstrated evidenced evident articulated".split()
PASSAGES = "passage excerpt segment quote".split()
NEVER = "show demonstrate exhibit reflect indicate".split()
SHOWING_ZH = {"未": "表現出 表现出 展現 展现 顯示 显示 呈現 呈现 體現 体现".split(), "沒有": "表現 展現 顯示 呈現 體現".split(), "没有": "表现 展现 显示 呈现 体现".split()}
UNSEEN_ZH = "看不出 無法看出 无法看出 不足以顯示 不足以显示 未見證據 未見跡象 未見任何證據 未見任何跡象".split()
PASSAGES_ZH, LACKING_ZH = "本段 這段 该段 此段".split(), "沒有 没有 未".split()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


ABSENCE = "(?i)" + "|".join([
    rf"\b(?:does|did|do)\s*n[o']t\s+{_any(SHOWING)}\b",
    rf"\bfail(?:s|ed|ing)?\s+to\s+{_any(FAILING)}\b",
    rf"\bno\s+{_any(TRACES)}\s+of\b",
    rf"\bnot\s+{_any(SHOWN)}\b",
    rf"\bnothing\s+(?:here|in\s+this\s+{_any(PASSAGES)})\b",
    rf"\bthe\s+{_any([*PASSAGES, 'speaker'])}\s+never\s+{_any(NEVER)}\b",
    *(no + _any(verbs) for no, verbs in SHOWING_ZH.items()),
    *UNSEEN_ZH,
    rf"{_any(PASSAGES_ZH)}[^，。；]{{0,12}}{_any(LACKING_ZH)}",
])


def is_absence(c: Column) -> Column:
    """Rationales that argue from the passage not showing something; null counts as no."""
    return F.coalesce(c.rlike(ABSENCE), F.lit(False))


def simplified_in(c: Column, letters: str) -> Column:
    """Distinct characters of ``c`` that are in ``letters``, sorted."""
    return F.array_sort(F.array_intersect(F.array_distinct(F.split(c, "")), F.array(*[F.lit(x) for x in letters])))
