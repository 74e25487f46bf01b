"""Sentence boundaries across languages and scripts by cascading segmentation rules.

A rule is a pair of regular expressions, one for the text before a position and one for
the text after it, with a decision: break or no break. Tables of rules are cascaded per
language (own table first, then the tables shared by its script, then the common one);
at each position the first rule that matches decides. Positions are found once per text
by one scan for places where any break rule could apply, so the cost grows with the
number of stops, not with the number of rules times the text.

Defined results: null text gives no rows, empty or blank text neither; text of any length
is processed whole; positions count Unicode characters from 0, end exclusive, surrounding
white space excluded. A text without stops is one sentence per line or gap.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: marks -----------------------------------------------------------------
OPEN = r"\"'“‘„‚«‹「『（(\[【〈《¿¡"
CLOSE = r"\"'”’“»›」』）)\]】〉》"
STOP = r".!?…。！？｡؟۔।॥"
CJK_STOP = r"。！？｡!?"
# --- Fixed values: abbreviations -----------------------------------------------------------
#: A name or title follows.
TITLES = (
    "Dr|Drs|Mr|Mrs|Ms|Mx|Prof|Rev|Hon|St|Ste|Mt|Ft|Gen|Col|Capt|Lt|Sgt|Cpl|Maj|Cllr|Sen|Rep|Gov|Pres|Supt|Insp|"
    "Sr|Sra|Srta|Dra|Don|Dña|Lic|Ing|Arq|M|MM|Mme|Mmes|Mlle|Me|Mgr|Hr|Fr|Hrn|Dipl|Mag|Dott|Sig"
)
#: A number follows.
NUMBERED = (
    "No|Nos|Nr|Nrn|Num|Núm|núm|num|n|Fig|Figs|Abb|Tab|Eq|Ex|Sec|Sect|Ch|Chap|Cap|Kap|Art|Arts|Abs|Ziff|Par|Para|Paras|"
    "Pág|Págs|pág|p|pp|S|fol|Vol|Vols|Bd|Ed|Est|Approx|Aprox|Ca|Circ|Env|Rd|Ext|Ver|Rev|Pt|Apt|Ste|Unit|Flat|Rm|Bldg|Op|Ref|Reg|Ser|Fn|Bl|Az|Tel|T|F"
)
#: Never at the end of a sentence unless something else says so.
INNER = (
    "e\\.g|i\\.e|cf|vs|viz|incl|excl|approx|aprox|bzw|bspw|vgl|inkl|exkl|zzgl|ggf|evtl|sog|ca|d\\.\\s?h|z\\.\\s?B|u\\.\\s?a|"
    "o\\.\\s?ä|i\\.\\s?d\\.\\s?R|p\\.\\s?ex|p\\.\\s?ej|c\\.-à-d|c\\.\\s?à\\s?d|env|resp|av|bd|avda|Avda|pza|boul|dept|dép|tel|ext|al|P\\.\\s?O|E\\.\\s?U|EE"
)
#: May end a sentence; the next word decides.
EITHER = "etc|usw|usf|ff|Inc|Ltd|Co|Corp|Bros|Plc|LLC|GmbH|Jr|Sr|Ph\\.D|a\\.\\s?m|p\\.\\s?m|A\\.M|P\\.M|est|no|Ave|Rd|Blvd|Dept|Univ|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
#: Words that start a sentence rather than continue a name.
STARTERS = (
    "The|A|An|We|They|It|He|She|I|You|This|That|These|Those|There|Then|Their|Our|My|Your|His|Her|Its|In|On|At|By|For|From|"
    "With|Before|After|Under|Over|But|And|So|Or|If|When|While|Who|What|Why|Where|How|Nobody|Everyone|Someone|Not|No|Yes|As|To|"
    "Der|Die|Das|Ein|Eine|Wir|Sie|Es|Er|Ich|Im|Nach|Für|Warum|Wer|Was|Niemand|Neue|Laut|Le|La|Les|L|Un|Une|Nous|Ils|Elle|Il|"
    "Pour|Pourquoi|Personne|Après|Selon|Voir|El|Los|Las|Una|Nadie|Después|Según|Para|Por|En|Nos|Ellos"
)
DAY_WORDS = "im|am|der|die|das|den|dem|des|vom|zum|zur|bis|seit|ab"


@dataclass(frozen=True)
class Rule:
    """Break or no break where ``before`` ends and ``after`` starts."""

    name: str
    breaks: bool
    before: str
    after: str
    #: The rule can only apply to texts that hold one of these characters (empty: to any).
    needs: str = ""

    @property
    def pattern(self) -> regex.Pattern:
        return _compiled(self.before, self.after)


@lru_cache(maxsize=None)
def _compiled(before: str, after: str) -> regex.Pattern:
    return regex.compile(f"(?<={before})(?={after})" if before else f"(?={after})", regex.M)


def _no(name: str, before: str, after: str, needs: str = "") -> Rule:
    return Rule(name, False, before, after, needs)


def _yes(name: str, before: str, after: str, needs: str = "") -> Rule:
    return Rule(name, True, before, after, needs)


#: Lines and gaps end a statement whatever comes before.
LINES = [
    _yes("line", r"", r"[^\S\n\r]*[\n\r  \x85]"),
    _yes("gap", rf"[^\s]", r"(?:[　]|[^\S\n\r]{2,})\s*\S"),
]

@dataclass(frozen=True)
class Enclosure:
    """No break inside what ``pattern`` matches, found by one scan of the text however long it is.

    Inside is from after the match's group ``open`` (else its first character) to before its
    group ``close`` (else its last one).
    """

    name: str
    pattern: regex.Pattern

    def intervals(self, text: str) -> Iterator[tuple[int, int]]:
        """(first, last) position without a break, per match."""
        named = self.pattern.groupindex
        for m in self.pattern.finditer(text):
            yield (m.end("open"), m.start("close")) if named else (m.start() + 1, m.end() - 1)


#: Stops inside a quotation or brackets end nothing. A mark runs to the next one of its kind in the line.
QUOTES = [
    Enclosure("double curly", regex.compile(r"“[^“”\n]*+”")),
    Enclosure("low-high", regex.compile(r"„[^„“”\n]*+[“”]")),
    Enclosure("guillemets", regex.compile(r"«[^«»\n]*+»")),
    Enclosure("corner", regex.compile(r"「[^「」\n]*+」")),
    Enclosure("white corner", regex.compile(r"『[^『』\n]*+』")),
    Enclosure("straight", regex.compile(r"\"[^\"\n]*+\"")),
    Enclosure("single", regex.compile(r"(?P<open>(?<![\p{L}\p{N}])['‘](?=\p{L}))(?:(?!(?<![\p{L}\p{N}])['‘]\p{L}|[.!?,…]['’](?!\p{L}))[^\n])*+(?P<close>[.!?,…]['’](?!\p{L}))")),
    Enclosure("brackets", regex.compile(r"[(（\[【][^()（）\[\]【】\n]*+[)）\]】]")),
]
_ENCLOSING = regex.compile(r"[“„«「『\"'‘(（\[【]")

#: What follows a closed quotation in the scripts without case.
CJK = [
    _no("reported by a particle", r"[」』”]", r"\s*(?:と|って|という|など|の|は|が|を|に|も|で)"),
    _no("quotation opens the sentence", r"(?:^|[。！？!?」』）)\s])[「『“][^「」『』“”\n]*+[」』”]", r"\p{Han}"),
    _no("hesitation", r"(?:…|⋯|\.\.|・・)", r"[^\s]"),
    _no("before closing or pause", r"[。！？｡!?」』”’）)】]", r"\s*[，、；：,;:…」』”）)】]"),
    _yes("stop", rf"[{CJK_STOP}][」』”’）)】]*", r"[\s\S]"),
    _no("full stop of numbers and names", r"[.．]", r"[\s\S]"),
    _yes("closed quotation after a lead-in", r"[：:，,][「『“][^「」『』“”\n]*+[。！？!?…][」』”]", r"\s*\S"),
]

THAI = [
    _no("beside digits or Latin", r"[\p{N}\p{Latin}][^\s]?", r"\s+\p{Thai}"),
    _no("before digits or Latin", r"\p{Thai}", r"\s+[\p{N}\p{Latin}+]"),
    _no("before a quotation or bracket", r"\p{Thai}", r"\s+[“\"'‘(（\[]"),
    _no("before the sign of repetition", r"\p{Thai}", r"\s+[ๆฯ]"),
    _no("politeness or continuation", r"\p{Thai}", r"\s+(?:ครับ|ค่ะ|คะ|นะ)(?!\p{Thai})"),
    _yes("gap", r"[\p{Thai}”\"’)ๆฯ!?]", r"\s+\p{Thai}"),
    _yes("stop", rf"[!?][{CLOSE}]*", r"\s+\S"),
]

ARABIC = [
    _no("abbreviation of a title", r"(?:^|[\s(«])[\p{Arabic}]{1,2}\.", r"\s"),
    _yes("stop", rf"[.!؟۔?…][{CLOSE}]*", r"\s+\S"),
]

DEVANAGARI = [
    _no("abbreviation", r"(?:^|[\s(“])[\p{Devanagari}]{1,4}\.", r"\s"),
    _yes("danda", rf"[।॥!?][{CLOSE}]*", r"\s*\S"),
    _yes("stop", rf"[.…][{CLOSE}]*", r"\s+\S"),
]

GERMAN = [
    _no("ordinal after an article", rf"\b(?i:{DAY_WORDS})\s\d{{1,2}}\.", r"\s\p{L}"),
    _no("ordinal before a month or floor", r"\b\d{1,2}\.", r"\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Stock|Etage|Klasse|Kapitel|Jahrhundert|Mal)\b"),
]

LATIN = [
    _no("inside an address", r"[\p{L}\p{N}._%+-]{0,80}[.]", r"[\p{L}\p{N}._%+-]{0,80}@", "@"),
    _no("inside a host name", r"[@/][\p{L}\p{N}.-]{0,120}[.]", r"[\p{L}\p{N}]", "@/"),
    _yes("brackets of their own", r"(?:^|[.!?…”\"»’)]\s+)[(\[]\p{Lu}[^()\[\]\n]*+[.!?…][)\]]", r"\s+\S", ")]"),
    _no("continued after a quotation", rf"[{STOP}][”’»“\"')\]]+", r"\s*(?:[,;:–—-]|\p{Ll}+\b(?!:))", "”’»“\"')]"),
    _no("hesitation", r"(?:…|\.\.)", r"\s*[\p{Ll}\p{N}]"),
    _no("title", rf"(?<![\p{{L}}.])(?:{TITLES})\.", r"\s+\S"),
    _no("numbered", rf"(?<!\p{{L}})(?i:{NUMBERED})\.", r"\s*[(#]?\d"),
    _no("abbreviation of two words", r"(?<![\p{L}.])(?:z|d|u|i|o|p|c|P|v)\.", r"\s?(?:B|h|a|d|R|ä|ex|ej|à|O|H|Chr)\.?(?!\p{L})"),
    _no("roman number", r"(?<![\p{L}.])(?i:no|nr|fig|art|ch|chap|vol|cap|kap)\.", r"\s+[IVXLC]+\b"),
    _yes("either, then a sentence", rf"(?<![\p{{L}}.])(?:{EITHER})\.[{CLOSE}]*", rf"\s+[{OPEN}]*(?:\p{{Lu}}|\d|\p{{Ll}}+\p{{Lu}})"),
    _no("either, within", rf"(?<![\p{{L}}.])(?:{EITHER})\.", r"\s+\S"),
    _no("inner", rf"(?<![\p{{L}}.])(?i:{INNER})\.", r"\s*\S"),
    _yes("letter at the end", r"\s\p{Lu}\.", rf"\s+(?:{STARTERS})(?![.\p{{L}}])"),
    _no("initial", r"(?:^|(?<![\d])[\s(“\"'«„-]|\.)\p{Lu}\.", r"\s*\p{Lu}"),
    _yes("acronym at the end", r"(?:\p{Lu}\.){2,}", rf"\s+(?:{STARTERS})(?![.\p{{L}}])"),
    _no("acronym", r"(?:\p{Lu}\.){2,}", r"\s*\S"),
    _no("lower case goes on", rf"[{STOP}]+", r"\s+\p{Ll}+(?![\p{L}\p{N}]|:|[\p{L}\p{N}._+-]*\s?[@＠])"),
    _yes("stop", rf"[{STOP}]+[{CLOSE}]*", rf"\s+[{OPEN}–—]*\s?[\p{{Lu}}\p{{Lo}}\p{{N}}]"),
    _yes("stop before another script or sign", rf"[{STOP}]+[{CLOSE}]*", rf"\s+[{OPEN}]"),
    _yes("stop before an uncommon lower-case word", rf"[{STOP}]+[{CLOSE}]*", r"\s+\p{Ll}[\p{L}\p{N}._+-]*(?:\p{Lu}|:|\s?[@＠])"),
    _yes("stop without a blank", r"(?:[\p{Ll}\p{N}]{2}|[\p{Ll}\p{N}][”’»\")])[.!?][”’»)]*", rf"[{OPEN}]*\p{{Lu}}[\p{{Ll}}'’]"),
    _yes("stop without a blank before a one-letter word", r"\p{Ll}{2}[.!?][”’»)]*", r"(?:I|A|Y|O|À)\s"),
    _yes("closed quotation without a blank", r"[.!?…][”»]", r"\p{Lu}\p{Ll}"),
]

#: Language to its cascade of tables.
CASCADES: dict[str, list[list[Rule] | list[Enclosure]]] = {
    "zh": [LINES, QUOTES, CJK, LATIN],
    "ja": [LINES, QUOTES, CJK, LATIN],
    "th": [LINES, QUOTES, THAI, LATIN],
    "ar": [LINES, QUOTES, ARABIC, LATIN],
    "hi": [LINES, QUOTES, DEVANAGARI, LATIN],
    "de": [LINES, QUOTES, GERMAN, LATIN],
    "en": [LINES, QUOTES, LATIN],
    "fr": [LINES, QUOTES, LATIN],
    "es": [LINES, QUOTES, LATIN],
}

_GERMAN_WORDS = regex.compile(r"\b(?:der|die|das|und|nicht|ist|wurde|für|von|mit|ein|eine|wir|sich|auf|dem|den|im)\b")
_ENGLISH_WORDS = regex.compile(r"\b(?:the|and|was|were|of|to|that|with|we|it)\b")
_SCRIPTS = [("th", regex.compile(r"\p{Thai}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}"))]
_WORDS = regex.compile(r"\p{Latin}{2,}")


def language_of(text: str) -> str:
    """Rule language of a text by its scripts and, for Latin script, function words."""
    found = {name: len(p.findall(text)) for name, p in _SCRIPTS}
    latin = len(_WORDS.findall(text))
    if found["ja"] and found["ja"] + found["zh"] > latin:
        return "ja" if found["ja"] * 8 >= found["zh"] else "zh"
    name = max(found, key=lambda k: found[k])
    if found[name] > latin:
        return name
    return "de" if len(_GERMAN_WORDS.findall(text)) > len(_ENGLISH_WORDS.findall(text)) else "en"


_GAP_LANGUAGES = {"th"}
_CANDIDATE = regex.compile(rf"[{STOP}]+[{CLOSE}]*|[」』”»\")）](?=\S)|\S(?=[^\S\n\r]*[\n\r  \x85])|\S(?=　|[^\S\n\r]{{2,}})")
_THAI_CANDIDATE = regex.compile(rf"\S(?=\s)|[{STOP}]+[{CLOSE}]*")


@lru_cache(maxsize=None)
def _tables(lang: str) -> list[list[tuple[regex.Pattern, bool, str]] | None]:
    """Compiled rules per table of a cascade; None stands for the enclosures."""
    return [None if isinstance(table[0], Enclosure) else [(r.pattern, r.breaks, r.needs) for r in table] for table in CASCADES[lang]]


def _inside(text: str) -> tuple[list[int], list[int]]:
    """Firsts and lasts of the positions inside any enclosure, disjoint and in order."""
    firsts, lasts = [], []
    if _ENCLOSING.search(text):
        for a, b in sorted(i for e in QUOTES for i in e.intervals(text)):
            if lasts and a <= lasts[-1] + 1:
                lasts[-1] = max(lasts[-1], b)
            else:
                firsts.append(a)
                lasts.append(b)
    return firsts, lasts


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``; see the module for the rules."""
    if not text or not text.strip():
        return []
    lang = lang if lang in CASCADES else language_of(text)
    firsts, lasts = _inside(text)
    tables = [t and [(p, breaks) for p, breaks, needs in t if not needs or any(c in text for c in needs)] for t in _tables(lang)]

    def breaks_at(pos: int) -> bool:
        for table in tables:
            if table is None:
                k = bisect_right(firsts, pos) - 1
                if k >= 0 and pos <= lasts[k]:
                    return False
                continue
            for pattern, breaks in table:
                if pattern.match(text, pos):
                    return breaks
        return False

    found = (m.end() for m in (_THAI_CANDIDATE if lang in _GAP_LANGUAGES else _CANDIDATE).finditer(text))
    cuts = [pos for pos in found if pos < len(text) and breaks_at(pos)]
    spans, start = [], 0
    for cut in [*sorted(set(cuts)), len(text)]:
        a, b = start, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))
        start = cut
    return spans


def split_sentences(df: DataFrame, keys: list[str], text: str, lang: str | None = None) -> DataFrame:
    """One row per sentence: the key columns, start_pos, end_pos.

    One pass without a shuffle; only keys and text reach Python. ``lang`` names a column
    with the language where it is known.
    """
    slim = df.select(*keys, F.col(text).alias("__text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("__lang")).filter(F.col("__text").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, starts, ends = [], [], []
            for i, (t, code) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                for a, b in sentence_spans(t, code):
                    take.append(i)
                    starts.append(a)
                    ends.append(b)
            rows = pa.array(take, pa.int64())
            cols = [batch.column(k).take(rows) for k in range(len(keys))] + [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "start_pos", "end_pos"])

    return slim.mapInArrow(run, f"{schema}, start_pos int, end_pos int")
