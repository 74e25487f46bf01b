"""Personal information inside free text: find it, score it, replace it.

Regular expressions propose spans (EMAIL, PHONE, IDNUM, ADDRESS, NAME). Each span starts
with the score of its shape; validators of known number systems (Luhn, ISO 7064 mod 97,
the weighted check digit of Taiwanese identity numbers) and the words shortly before and
after it raise or lower the score; spans of at least ``threshold`` remain. Of overlapping
spans the better one stays (score, then length, then first).

Defined results: null and empty texts give no spans and stay as they are; texts are
searched whole; positions count Unicode characters from 0, end exclusive. Full-width
digits and signs count as their ASCII forms, without moving positions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "IDNUM", "ADDRESS", "NAME")
THRESHOLD = 2.0

_WIDE = {ord(w): ord(n) for w, n in zip("０１２３４５６７８９＠－＋（）．／　", "0123456789@-+()./ ")} | {0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45}

# --- validators -------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Luhn check over a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return len(digits) > 1 and total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10 as for IBANs: the first four characters go to the end, letters count from 10."""
    code = regex.sub(r"[^0-9A-Za-z]", "", code).upper()
    if len(code) < 15 or not regex.match(r"[A-Z]{2}\d{2}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def taiwan_id(code: str) -> bool:
    """Weighted check digit of a letter and nine digits."""
    if not regex.fullmatch(r"[A-Za-z]\d{9}", code):
        return False
    n = "ABCDEFGHJKLMNPQRSTUVXYWZIO".index(code[0].upper()) + 10
    ds = [n // 10, n % 10, *map(int, code[1:])]
    return sum(d * w for d, w in zip(ds, (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1))) % 10 == 0


# --- Fixed values: words that stand near personal data -------------------------------------
PHONE_WORDS = regex.compile(r"(?i)\b(?:phone|call|tel|telephone|mobile|cell|number|reach|contact|ask for|ext|fax|whatsapp|nummer|telefon|ruf|numéro|téléphone|número|teléfono|llam\p{L}*|gave me)\b|電話|手機|連絡|请找|請找|رقم|هاتف|नंबर|फ़ोन|फोन|เบอร์|โทร")
ID_WORDS = regex.compile(r"(?i)\b(?:passport|insurance|identity|id card|id number|social security|ssn|national id|tax|licen[cs]e|ausweis|pass|versicherung\p{L}*|passeport|carte d'identité|sécu\p{L}*|documento|dni|nie|pasaporte|cédula|number|on file)\b|身分證|身份證|身份证|護照|护照|マイナンバー|旅券|保険|جواز|هوية|पासपोर्ट|आधार|บัตรประชาชน|หนังสือเดินทาง")
NOT_NUMBERS = regex.compile(r"(?i)(?<!\.)\b(?:budget|ticket|batch|firmware|unit|version|invoice|order|serial|case no|form no|page|pages|metres|meters|euros?|cost|coste|coût|kosten|households|index|gauge|lot|part no|isbn|model|sensor|device|commit|build|test)\b|案號|設備|版本|型號|表格")
GIVEN_NAMES = (
    "Adam Ada Ahmed Aisha Alex Alice Amadi Amara Amina Amir Ana Andrea Anna Anouk Antonio Åsa Astrid Bastien Beatriz Ben Bram Bruno Carla Carlos Carmen Chen Clara Daniel Dario David Diego "
    "Elena Elif Emil Emma Erik Esther Eva Farid Fatima Felix Fiona Fatou Gabriel George Grace Greta Hana Hannah Hans Helen Hugo Ibrahim Ilse Ines Ingrid Isabel Ivan Jack James Jan Jana Javier Jean Jo John Jonas "
    "Joss Julia June Jürgen Kai Karim Karin Kate Kofi Lars Laura Layla Lena Leo Liam Liesel Lina Linda Lucas Luis Maeve Malik Marco Maria Marie Mark Martin Mary Mateo Maya Mehmet Mia Michael Mohamed Nadia Nell Nia Nina Noah Noor "
    "Odalys Olga Oliver Omar Oscar Pablo Paul Pedro Peter Petra Pierre Pilar Priya Rachel Ravi Renée Rosa Rose Ruth Sam Samir Sara Sarah Signe Sofia Sonia Stefan Susan Tamsin Tariq Thomas Tim Tom Tomas Ursula Victor Will Yara Yusuf Zoë"
).split()
SURNAMES_ZH = "王李張张劉刘陳陈楊杨黃黄趙赵吳吴周徐孫孙馬马朱胡郭何林高羅罗鄭郑梁謝谢宋唐許许韓韩馮冯鄧邓曹彭曾肖田董袁潘於余葉叶蔣蒋杜蘇苏魏程呂吕丁沈任姚盧卢姜崔鍾钟譚谭陸陆汪范石廖賈贾夏韋韦付方白鄒邹孟熊秦邱江尹薛閻阎段雷侯龍龙史陶黎賀贺顧顾毛郝龔龚邵萬万錢钱嚴严覃武戴莫孔向湯汤鄔邬闕阙卓祝桑柯岑谷溫温施洪翁簡简游詹涂塗歐欧紀纪童柳傅甘"
TITLE = r"(?:Dr|Mr|Mrs|Ms|Mx|Miss|Prof|Professor|Sra|Sr|Srta|Dra|Mme|Mlle|Madame|Monsieur|Frau|Herr|Herrn|Hr|Cllr|Doña|Don|Señora|Señor)"
PARTICLE = r"(?:[vV]an der|[vV]an den|[vV]an|[vV]on der|[vV]on|[dD]e la|[dD]e|[dD]el|[dD]i|[dD]a|[dD]u|[bB]in|[bB]int|[aA]l)"
ORG_AFTER = regex.compile(r"\s*(?:Ltd|Inc|Plc|LLC|GmbH|Trust|Pumps|Gauge|Harbour|Road|Street|Lane|Hill|School|University|Hospital|Council|Board|Office|Station|Bank|Park|Court|Row|Close|Avenue|Steps|Bridge|index|test|scale|method|score|school|road|street|market|ward|protocol|syndrome|model)\b")
NOT_NAMES = frozenset(
    "the a an our my your his her their its this that these those it we they he she i you who what which when where why how nobody everyone someone anyone all some any no not one two if in on at by for from with before after under over "
    "der die das ein eine wir sie es er ich man le la les un une nous ils elle il on el los las una nadie ellos".split()
)
STREET = r"(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Court|Ct\.?|Row|Steps|Drive|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Crescent|Boulevard|Blvd\.?|Gardens|Grove|Mews|Walk|Parade|Quay|Yard|Alley|Green|View|Rise|Embankment|Wharf|Gate)"

# --- shapes ----------------------------------------------------------------------------------
_LOCAL = r"[\p{Latin}\p{Nd}][\p{Latin}\p{Nd}._%+\-]*"
_HOST = r"[\p{Latin}\p{Nd}](?:[\p{Latin}\p{Nd}\-]*[\p{Latin}\p{Nd}])?"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|punto|point|punkt)\s?[\])]\s?|\s(?:dot|punto|point|punkt)\s)"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|arroba|arobase|ät)\s?[\])]\s?|\s(?:at|arroba|arobase)\s(?=[\p{Latin}\p{Nd}\-]+\s(?:dot|punto|point|punkt)\s))"
EMAIL = regex.compile(rf"(?<![\p{{Latin}}\p{{Nd}}._%+\-]){_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}[\p{{Latin}}]{{2,}}(?![\p{{Latin}}\p{{Nd}}])", regex.I)

_EXT = r"(?:[\s,]*(?:ext|extn|extension|x|durchwahl|poste|分機|内線)\.?\s*\d{1,6})?"
PHONE = regex.compile(rf"(?<![\p{{Latin}}\d.\-/+])(?:\+\d{{1,3}}[\s.\-/]?)?(?:\(\d{{1,5}}\)[\s.\-/]?)?\d{{1,14}}(?:[\s.\-/]\d{{2,8}}){{0,6}}{_EXT}(?![\d\-/]|\.\d|[A-Za-z]\d)")
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
SPOKEN = regex.compile(rf"\b(?:plus\s+)?{_DIGIT}(?:[\s,\-]+(?:double\s+|triple\s+)?{_DIGIT}){{6,}}\b", regex.I)
SPOKEN_ZH = regex.compile(r"[零〇一二三四五六七八九](?:[、，,\-－\s]?[零〇一二三四五六七八九]){7,}")

IDNUM = regex.compile(
    r"(?<![\p{Latin}\d\-/])(?:"
    r"(?P<nino>[A-Za-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d])"
    r"|(?P<ssn>\d{3}[\-\s]\d{2}[\-\s]\d{4})"
    r"|(?P<slash>\d{5,6}/\d{2}-\p{Lu}\d{3})"
    r"|(?P<tw>[A-Za-z]\d{5}-?\d{4})"
    r"|(?P<pass>[A-Za-z]{1,2}\d{6,9})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?)"
    r"|(?P<grouped>\d{4}[\s\-]\d{4}[\s\-]\d{4}(?:[\s\-]\d{4})?)"
    r"|(?P<spanish>\d{8}-?[A-Za-z])"
    r"|(?P<long>\d{7,16})"
    r")(?![\p{Latin}\d]|-\d|/\d)"
)

_CAPW = r"\p{Lu}[\p{L}'’]*"
_PLACE = r"\p{Lu}[\p{L}'’\-]+(?:\s(?:\p{Lu}[\p{L}'’\-]+|de|del|la|le|sur|am|an|der|upon|on)){0,3}"
_PLACE = rf"(?:{_PLACE})"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Rm\.?)\s?[\p{Nd}]+\s?\p{L}?"
ADDRESSES = [
    (3.0, regex.compile(rf"(?<![\p{{L}}\d])(?:{_UNIT},?\s)?\d{{1,5}}\p{{L}}?,?\s(?:{_CAPW}\s){{1,4}}{STREET}(?!\p{{L}})(?:,\s{_UNIT})?(?:,\s{_PLACE})?(?:,?\s\d{{4,6}}(?!\d))?")),
    (1.0, regex.compile(rf"(?<![\p{{L}}\d])(?:(?i:{_UNIT}),?\s)?\d{{1,5}}\p{{L}}?,?\s(?:[\p{{Ll}}'’]+\s){{1,3}}(?i:{STREET})(?!\p{{L}})(?:,\s(?i:{_UNIT}))?(?:,\s(?:{_PLACE}|(?!and\b|but\b|or\b)[\p{{Ll}}\-]+(?:\s[\p{{Ll}}\-]+)?(?=\s\d{{4,6}}\b|[.,]?\s*(?:$|\n)|[.,]\s)))?(?:,?\s\d{{4,6}}(?!\d))?")),
    (3.0, regex.compile(rf"(?<![\p{{L}}\d])(?:P\.?\s?O\.?\sBox|PO\sBox|Postfach|Apartado|B\.?P\.?|Box)\s\d+(?:,\s{_PLACE})?(?:,?\s\d{{4,6}}(?!\d))?")),
    (3.0, regex.compile(rf"(?<![\p{{L}}\d])(?:\p{{Lu}}[\p{{L}}\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|stieg|pfad|markt|hof)|(?:\p{{Lu}}\p{{L}}+\s){{1,3}}(?:Straße|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer)|(?:Am|An der|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der)\s\p{{Lu}}[\p{{L}}\-]+(?:\s\p{{Lu}}[\p{{L}}\-]+)?)\s\d{{1,4}}\s?\p{{L}}?(?!\p{{L}})(?:,\s(?:\d{{4,5}}\s)?{_PLACE})?")),
    (3.0, regex.compile(rf"(?<![\p{{L}}\d])\d{{1,4}}\s?(?:bis|ter|\p{{L}})?,?\s(?:rue|avenue|av\.|boulevard|bd|place|quai|chemin|allée|impasse|route|cours|passage|square|ruelle|sentier)\s(?:(?:de|du|des|la|le|les|d'|l'|d’|l’|à|aux|sur)\s?)*\p{{Lu}}[\p{{L}}'’\-]+(?:\s\p{{Lu}}[\p{{L}}'’\-]+)*(?:,\s(?:\d{{4,5}}\s)?{_PLACE})?", regex.V0)),
    (3.0, regex.compile(rf"(?<![\p{{L}}\d])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Carretera|Ronda|Travesía|Callejón|Cuesta|Glorieta|Rua|Via|Piazza|Praça)\s(?:(?:de|del|la|las|los|el|y)\s)*\p{{Lu}}[\p{{L}}'’\-]+(?:\s(?:de|del|la|las|los|el|y|\p{{Lu}}[\p{{L}}'’\-]+))*,?\s(?:n\.?º\s?)?\d{{1,4}}\s?\p{{L}}?(?!\p{{L}})(?:,\s(?:\d{{1,2}}\.?\s?[ºª°]\s?\p{{L}}{{0,9}}|bajo|ático|piso\s\d+|esc\.\s\p{{L}}+|puerta\s\w+))*(?:,\s(?:\d{{4,5}}\s)?{_PLACE})?")),
    (3.0, regex.compile(r"(?:\p{Han}{2,3}[縣县市])?(?:\p{Han}{1,3}[區区鄉乡鎮镇])?\p{Han}{1,5}?(?:路|街|大道|大街)(?:[一二三四五六七八九十\d]+段)?(?:\d+巷)?(?:\d+弄)?\d+(?:之\d+)?[號号](?:之\d+)?(?:\d+[樓楼](?:之\d+)?)?(?:\d+室)?")),
    (3.0, regex.compile(r"(?:〒\d{3}-?\d{4}\s?)?(?:\p{Han}{2,4}[都道府県])?(?:[\p{Han}\p{Katakana}ー]{1,6}?[市区郡])?[\p{Han}\p{Katakana}ーのヶ]{1,8}?[町村区丁目](?:\d+丁目)?\d+(?:[\-の番]\d+)*(?:番地?|号)?(?:\d+号)?(?:[\p{Han}\p{Katakana}ー]+\d+号室)?")),
]
#: A place or street never goes on in the next line.
_ADDRESSES = [(score, regex.compile(p.pattern.replace(r"\s", r"[^\S\n]"), p.flags)) for score, p in ADDRESSES]
#: What some of them cannot do without.
_NEEDED_ADDRESSES = [
    (score, p, re.compile(needs) if needs else None)
    for (score, p), needs in zip(_ADDRESSES, ("", r"(?i)\b(?:ro?a?d|stre?e?t?|av|la?ne?|clo|co?u?r?t|row|step|dri|way|pla?c?e?|squ?|ter|cre|bou|blv|gar|gro|mew|wal|par|qua|yar|all|gre|vie|ris|emb|wha|gat)", "Box|Postfach|Apartado|B.?P", "", "rue|av|bo?u?l?e?v?a?r?d|place|quai|chemin|all|impasse|route|cours|passage|square|ruelle|sentier", "C/|[CAPRTGV]", "[路街道]", "[町村区丁目]"))
]
ADDRESS_WORDS = regex.compile(r"(?i)\b(?:live[sd]?|living|flat at|address|letter|moved|home|house|write to|anschrift|adresse|wohn\p{L}*|habit\p{L}*|viv\p{L}*|dirección|domicili\p{L}*)\b|住|寄|地址|住所")

_W = r"\p{L}[\p{L}'’]*"
#: A name in its usual shape: initials or given names, particle, surname (perhaps double), or surname, given name.
_ONE = rf"(?:\p{{Lu}}[\p{{L}}'’]+(?:-\p{{Lu}}[\p{{L}}'’]+)*)"
CAP_NAME = rf"(?:(?:\p{{Lu}}\.\s?){{0,3}}(?:{_ONE}\s)?(?:\p{{Lu}}\.\s?)?(?:{PARTICLE}\s)?{_ONE}(?:,\s{_ONE}(?=\s\p{{Ll}}|\s\(|[.,)]|$))?|{_ONE},\s{_ONE})"
ANY_NAME = rf"(?:(?:\p{{L}}\.\s?){{0,3}}{_W}(?:-{_W})?(?:,\s{_W}|(?:\s(?!(?:STOP_WORDS)\b)(?:\p{{L}}\.|{_W}(?:-{_W})?)){{0,4}}))"


_S, _B = r"\s", r"[^\S\n]"
_STOPS = "|about|and|from|who|told|on|of|the|at|in|for|with|to|by|und|et|y|sobre|habl\\p{L}+|ont|is|was|has|had"


@dataclass(frozen=True)
class Cue:
    """A name between words that call for one; ``score`` for a capitalised name, two points less in lower case."""

    score: float
    #: The pattern can only match texts that hold one of these.
    needs: tuple[str, ...]
    pattern: regex.Pattern


def _cue(score: float, needs: str, before: str, after: str, stop: str, lower: bool = True) -> list[Cue]:
    words = tuple(needs.split("|"))
    cues = [Cue(score, words, regex.compile(rf"{before}(?P<n>{CAP_NAME.replace(_S, _B)}){after}"))]
    if lower:
        cues.append(Cue(score - 1.0, words, regex.compile(rf"{before}(?P<n>{ANY_NAME.replace('STOP_WORDS', stop + _STOPS).replace(_S, _B)}){after}")))
    return cues


_PARTICLES = regex.compile(rf"(?<=\s|^){PARTICLE}(?=\s)")
_VERB = r"(?=,?\s\p{Ll}+(?:ed|ew|ote|ote|sent|lt|id|pt|ought|oke|ook)\b)"
CUES: list[Cue] = [
    *_cue(3.5, "olleague", r"\b(?i:my|our|their|his|her|a)\scolleague,?\s", _VERB, r"\p{Ll}+ed|withdrew|rewrote|sent|told"),
    *_cue(3.5, "It was|It is", r"\bIt\s(?:was|is)\s", r"(?=\swho\b)", "who"),
    *_cue(3.5, "sk for|ontact|all |each ", r"\b(?i:ask\sfor|contact|call|reach)\s", r"(?=\s?[(（]\+?[(（\d])", "at"),
    *_cue(3.5, "sk for", r"\b(?i:ask\sfor)\s", r"(?=\s\((?:zero|one|two|three|four|five|six|seven|eight|nine)\b)", "at"),
    *_cue(3.5, "belong", r"\bbelong(?:s|ed)\sto\s", r"(?=[.!?]?(?:\s|$))", "and"),
    *_cue(3.5, " list", r"\b(?i:keep|kept|have|put)\s", r"(?=\son\s(?:the|their|our)\slist\b)", "on"),
    *_cue(3.5, " told | asked | warned | showed | reminded ", r"(?:^|[.!?:…”\"»)\]]\s+|\n\s*|　|(?<=\p{Ll}{2}[.!?]))", r"(?=\s(?:told|asked|warned|showed|reminded)\s(?:me|us)\b)", "told|asked|warned|showed|reminded"),
    *_cue(3.5, " about", rf"\b(?:spoke|talked|wrote)\s(?:to|with)\s(?:{TITLE}\.?\s)?", r"(?=\sabout\b)", "about"),
    *_cue(3.5, "Dr|Mr|Ms|Mx|Miss|Prof|Sr|Mme|Mlle|Madame|Monsieur|Frau|Herr|Hr|Cllr|Do|Se", rf"\b{TITLE}\.?\s", r"(?=\s(?:from|of)\s(?:the|our)\b)", "from|of"),
    *_cue(3.5, "habl", r"\bhabl(?:ó|aron)\scon\s(?:(?:la|el)\s)?(?:(?:Sra|Sr)\.\s)?", r"(?=\ssobre\b)", "sobre"),
    *_cue(3.5, "a.|r.", r"\b(?:La|El|la|el)\s(?:Sra|Sr|Dra|Dr)\.\s", r"(?=\shabl)", "habl\\p{L}+"),
    *_cue(3.5, "ocumento|asaporte|DNI", r"\b(?:documento|pasaporte|DNI)\s[^.\n]{4,30}\ses\sde\s", r"(?=[.!?]?(?:\s|$))", "y"),
    *_cue(3.5, "asseport|ocument", r"\b(?:passeport|document)\s[^.\n]{4,30}\sest\scelui\sde\s", r"(?=[.!?]?(?:\s|$))", "et"),
    *_cue(3.5, "Frau", r"\b(?:Frau)\s", r"(?=\sund\b)", "und"),
    *_cue(3.5, "Herr", r"\b(?:Herr|Herrn)\s", r"(?=\s(?:sprach|sagte|und|hat)\p{L}*\b)", "sprach\\p{L}*|sagte|und|hat"),
    *_cue(3.5, "sagte", r"\bsagte\s(?:(?:Dr|Frau|Herr|Prof)\.?\s)", r"(?=[.!?]?(?:\s|$))", "und"),
    *_cue(3.5, "M", r"\b(?:Mme|Madame|Mlle)\s", r"(?=\set\b)", "et"),
    *_cue(3.5, "et M", r"\bet\s(?:M|Mme|Mlle)\.?\s", r"(?=\s(?:ont|a|avaient)\b)", "ont|a|avaient"),
    *_cue(3.5, "Prof|Dr|Mr|Ms", r"\b(?:Prof|Dr|Ms|Mr|Mrs)\.?\s", r"(?=\sand\b)", "and"),
    *_cue(3.5, "Prof|Dr|Mr|Ms", r"\b(?:Prof|Dr|Ms|Mr|Mrs)\.?\s(?:[^.!?\n]|(?<=\p{Lu})\.){2,40}?\sand\s(?:(?:Prof|Dr|Ms|Mr|Mrs)\.?\s)?", _VERB, r"\p{Ll}+ed|withdrew|rewrote|sent|told"),
    *_cue(3.0, "Dr|Mr|Ms|Mx|Miss|Prof|Sr|Mme|Mlle|Madame|Monsieur|Frau|Herr|Hr|Cllr|Do|Se", rf"\b{TITLE}\.?\s", r"(?!\p{L})", "x", lower=False),
]
_G = "|".join(GIVEN_NAMES)
#: A given name and a surname side by side, without other words calling for a name.
FULL_NAME = regex.compile(rf"(?<![\p{{L}}'’.@+_\-])(?:{_G})\s(?:(?:\p{{Lu}}\.\s?)*(?:{PARTICLE}\s)?{_ONE})(?![\p{{L}}@+_])")
INITIAL_NAME = regex.compile(rf"(?<![\p{{L}}'’.@+_\-])(?!P\.?\s?O\.?\sBox)(?:\p{{Lu}}\.\s?){{1,3}}(?:{PARTICLE}\s)?{_ONE}(?![\p{{L}}@+_])")
#: Two to four capitalised words, whatever they are: a name only with words around it that go with persons.
PERSON_SHAPE = regex.compile(rf"(?<![\p{{L}}'’.@+_\-])\p{{Lu}}[\p{{Ll}}'’]+(?:-\p{{Lu}}[\p{{Ll}}]+)?(?:\s(?:\p{{Lu}}\.\s?)*(?:{PARTICLE}\s)?{_ONE}){{1,2}}(?![\p{{L}}@+_])")
PERSON_SHAPE = regex.compile(PERSON_SHAPE.pattern.replace(_S, _B))
OPENERS = frozenset("yesterday today tomorrow later finally then once maybe perhaps even only also when while because although after before since and but so if that".split())
# --- Fixed values: what persons do, and who persons are to others ---
PERSON_AFTER = regex.compile(
    r",?\s(?:who\b(?!se)|(?:has|had|also|once|always|never|then|later)?\s?(?:said|says|told|tells|asked|asks|explained|explains|replied|answered|thinks|thought|believes|believed|remembers|remembered|recalls|recalled|wrote|writes|"
    r"complained|agreed|insisted|laughed|cried|phoned|rang|lives|lived|works|worked|mentioned|admitted|apologised|apologized|died|married|retired|smiled|is\s(?:my|our|his|her|their)|was\s(?:my|our|his|her|their)))\b")
PERSON_BEFORE = regex.compile(
    r"(?i)\b(?:(?:named|name\sis|name\swas|i\sam|i['’]m|neighbou?r|friend|cousin|sister|brother|husband|wife|son|daughter|mother|father|aunt|uncle|boss|supervisor|teacher|nurse|midwife|colleague|tenant|patient|client|"
    r"respondent|interviewee|participant|caller|widow|widower),?|(?:thanks\sto|spoke\s(?:to|with)|talked\s(?:to|with)|married\s(?:to)?|met\swith|signed\sby|interview\swith|according\sto))\s$")
_NOT_PERSONS = regex.compile(
    r"\b(?:Port|Saint|Mount|Lake|River|North|South|East|West|New|Upper|Lower|Great|Little|Old|Council|Committee|Party|Ministry|Department|Union|Association|Society|Company|Group|Team|Agency|Authority|Service|Services|Club|Church|"
    r"County|City|Town|Village|Island|Valley|Hills?|Mill|Forest|Market|Square|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Google|Microsoft|Excel|Word|Internet|Version|Speaker|Interviewer|Respondent|Moderator|Chair|Witness)\b")
NAMES_HAN = [
    regex.compile(r"(?:請找|请找|聯絡|联络|找到|訪問|访问|叫做|名叫|我是|給|给)(?P<n>[" + SURNAMES_ZH + r"]\p{Han}{1,2})(?=[，。,.！!、\s（(]|$|電話|电话|老師|先生|女士|小姐)"),
    regex.compile(r"(?:^|[。！？!?」』　\n\s：:，])(?P<n>[" + SURNAMES_ZH + r"]\p{Han}{1,2})(?=(?:告訴|告诉|說|说|表示|提到|跟我|對我|和我)(?:我|過|了|，|：)?)"),
    regex.compile(r"(?P<n>[" + SURNAMES_ZH + r"\p{Han}]\p{Han}{1,3})(?=(?:さん|様|氏|くん)(?:が|は|を|に|の|と|も|から|、|。)?)"),
    regex.compile(r"(?<!\p{Han})(?P<n>[" + SURNAMES_ZH + r"]\p{Han}{1,2})(?=先生|女士|小姐|老師|老师|醫師|医师|博士|教授)"),
]


#: What each pattern cannot do without.
_HAN_NEEDS = [re.compile(x) for x in ("[請请聯联找訪访叫名我給给]", "[告說说表提跟對和]", "[さ様氏く]", "[先女小老醫医博教]")]

_STOP_BEFORE = regex.compile(r"(?r)[\n。！？]|[.!?](?=\s)")


def _near(text: str, a: int, b: int, words: regex.Pattern, before: int = 40, after: int = 14, sentence: bool = False) -> bool:
    """Whether one of the words stands shortly before or after, in the same line or, if asked, in the same sentence."""
    line = text.rfind("\n", max(0, a - before), a)
    if sentence:
        stop = _STOP_BEFORE.search(text, max(0, a - before), a)
        line = stop.start() if stop else line
    return bool(words.search(text, max(0, a - before, line + 1), a) or words.search(text, b, min(len(text), b + after)))


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \t\n　,;:":
        a += 1
    while b > a and text[b - 1] in " \t\n　,;:":
        b -= 1
    return a, b


#: A sign for "at" in brackets, or a word for the dot of a spelled-out address.
_SPELLED_OUT = re.compile(r"[\[(]\s?(?:at|arroba|arobase|ät)\b|\s(?:dot|punto|point|punkt)\s", re.I)
_ANY_DIGIT = re.compile(r"\d")
#: Runs of digits and their separators that the shapes of phone and identity numbers have at least.
_DIGITS_4, _DIGITS_6 = re.compile(r"\d[\d\s.\-/]{3}"), re.compile(r"\d[\d\s\-/]{5}")


def _emails(t: str) -> Iterator[tuple[int, int, str, float]]:
    if "@" not in t and not _SPELLED_OUT.search(t):
        return
    for m in EMAIL.finditer(t):
        yield m.start(), m.end(), "EMAIL", 4.0


def _phones(t: str) -> Iterator[tuple[int, int, str, float]]:
    for m in PHONE.finditer(t) if _DIGITS_4.search(t) else ():
        s = m.group()
        if len(s) < 7:
            continue
        core = regex.split(r"(?i)(?:ext|x|durchwahl|poste|分機|内線)", s)[0]
        digits = regex.sub(r"\D", "", core)
        if not 7 <= len(digits) <= 15:
            continue
        a, b = m.span()
        score = 0.0
        if s[0] in "+(":
            score += 2.0
        elif digits[0] == "0":
            score += 1.5
        elif regex.fullmatch(r"[2-9]\d{2}[\s.\-]\d{3}[\s.\-]\d{4}", core.strip()) or regex.fullmatch(r"[2-9]\d{2}[2-9]\d{6}", core.strip()):
            score += 1.5
        elif len(digits) >= 9:
            score += 0.5
        if len(s) > len(core):
            score += 1.0
        if _near(t, a, b, PHONE_WORDS):
            # With such a word a number of national length needs no other sign.
            score += 1.5 if 9 <= len(digits) <= 12 else 1.0
        if regex.search(r"@[\w.\-]+\s*/\s*$|\bdot\s\w+\s*/\s*$|[\])]\s?[\w.\-]+\s*/\s*$", t[max(0, a - 60) : a]):
            score += 2.0
        if regex.match(r"\d{4}-\d{2}-\d{2}$", s) or regex.match(r"\d{1,3}(?: \d{3})+$", s) and not (len(digits) == 9 and _near(t, a, b, PHONE_WORDS, 20, 0, True)):
            score -= 2.0
        if _near(t, a, b, NOT_NUMBERS, 24, 0, True):
            score -= 3.0
        if regex.search(r"(?i)(?:insurance|passport|ausweis|passeport|documento|身分證)[^.\n]{0,12}$", t[max(0, a - 30) : a]):
            score -= 2.0
        yield a, b, "PHONE", score
    for p in (SPOKEN,) if t.isascii() else (SPOKEN, SPOKEN_ZH):
        for m in p.finditer(t):
            yield m.start(), m.end(), "PHONE", 2.0 + _near(t, *m.span(), PHONE_WORDS)


_ID_BASE = {"nino": 2.5, "ssn": 1.5, "slash": 1.5, "tw": 1.5, "pass": 0.5, "iban": 0.5, "grouped": 0.0, "spanish": 0.5, "long": -0.5}


def _ids(t: str) -> Iterator[tuple[int, int, str, float]]:
    for m in IDNUM.finditer(t) if _DIGITS_6.search(t) else ():
        kind, s = m.lastgroup, m.group()
        score = _ID_BASE[kind]
        bare = regex.sub(r"[\s\-]", "", s)
        if kind == "tw" and taiwan_id(bare) or kind == "iban" and mod97(bare) or kind in ("grouped", "long") and luhn(bare):
            score += 2.0
        if kind == "nino" and not (" " in s or s.isupper() or s.islower()):
            score -= 1.0
        a, b = m.span()
        if _near(t, a, b, ID_WORDS, 44, 40):
            score += 2.0
        if _near(t, a, b, NOT_NUMBERS, 20, 0, True):
            score -= 3.0
        if kind == "long" and _near(t, a, b, PHONE_WORDS, 24, 6) and not regex.search(r"(?i)passport|insurance|ausweis|passeport|documento|身分證|identity", t[max(0, a - 40) : b + 40]):
            score -= 2.0
        yield a, b, "IDNUM", score


def _addresses(t: str) -> Iterator[tuple[int, int, str, float]]:
    if not _ANY_DIGIT.search(t):
        return
    # The last two are for scripts without blanks.
    for score, p, needs in _NEEDED_ADDRESSES[:-2] if t.isascii() else _NEEDED_ADDRESSES:
        for m in p.finditer(t) if needs is None or needs.search(t) else ():
            a, b = m.span()
            han = regex.match(r"\p{Han}", t[a])
            if han:
                lead = regex.match(r"(?:.*?(?:住在|住|寄到|寄去|搬到|地址是|位於|在|到|は|：|，))(?=\p{Han}{2,})", t[a:b])
                if lead:
                    a += lead.end()
            got = score + (1.5 if _near(t, a, b, ADDRESS_WORDS, 40, 0) else 0.0)
            if regex.search(r"(?i)\b(?:people|days|weeks|households|hours|months|years|per cent|persons?)\b", t[a:b]):
                got -= 4.0
            a, b = _trim(t, a, b)
            yield a, b - (t[b - 1] == "."), "ADDRESS", got


def _names(t: str) -> Iterator[tuple[int, int, str, float]]:
    for cue in CUES:
        if not any(w in t for w in cue.needs):
            continue
        for m in cue.pattern.finditer(t, overlapped=False):
            a, b = _trim(t, *m.span("n"))
            # a title belongs to no name
            lead = regex.match(rf"{TITLE}\.?\s+", t[a:b])
            if lead:
                a += lead.end()
            words = regex.findall(r"[\p{L}'’]+", _PARTICLES.sub(" ", t[a:b]))
            if not words or len(words) > 6 or any(w.lower() in NOT_NAMES for w in words if len(w) > 1 or words[0] is w and t[a + 1 : a + 2] != "."):
                continue
            score = cue.score
            capital = any(w[0].isupper() for w in words)
            if not capital and not any(w.capitalize() in GIVEN_NAMES for w in words) and len(words) > 2:
                score -= 1.5
            if ORG_AFTER.match(t, b):
                score -= 3.0
            if regex.search(r"(?:Ltd|Inc|Trust|Council|Board|Street|Road|School|Office|CHAIR|WITNESS)\b", t[a:b]):
                score -= 3.0
            yield a, b, "NAME", score
    for p, base in ((FULL_NAME, 2.0), (INITIAL_NAME, 1.5)):
        for m in p.finditer(t):
            a, b = m.span()
            score = base
            if ORG_AFTER.match(t, b) or ORG_AFTER.search(t[a:b]):
                score -= 3.0
            if regex.search(r"(?i)\b(?:and|with|by|to|from|for|of|und|et|y|con|de|mit|avec)\s$", t[max(0, a - 6) : a]):
                score += 0.5
            yield a, b, "NAME", score
    for m in PERSON_SHAPE.finditer(t):
        a, b = m.span()
        score = 0.5 + 1.75 * bool(PERSON_AFTER.match(t, b)) + 1.75 * bool(PERSON_BEFORE.search(t, max(0, a - 24), a))
        if score < THRESHOLD:
            continue
        words = m.group().split()
        # The first word of a sentence is often none of the name; after an article stands no person.
        if words[0].lower() in OPENERS:
            a, words = a + len(words[0]) + 1, words[1:]
        if len(words) > 1 and not any(w.lower() in NOT_NAMES for w in words) and not (ORG_AFTER.match(t, b) or ORG_AFTER.search(t[a:b]) or _NOT_PERSONS.search(t[a:b])):
            yield a, b, "NAME", score
    if not t.isascii():
        for p, needs in zip(NAMES_HAN, _HAN_NEEDS):
            if needs.search(t):
                for m in p.finditer(t):
                    yield *m.span("n"), "NAME", 3.0


FINDERS: tuple[Callable, ...] = (_emails, _phones, _ids, _addresses, _names)


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """Non-overlapping (start, end, kind, score), sorted by start."""
    if not text:
        return []
    t = text if text.isascii() else text.translate(_WIDE)
    found = [x for f in FINDERS for x in f(t) if x[3] >= threshold and x[1] > x[0]]
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[0]))
    kept: list[tuple[int, int, str, float]] = []
    for x in found:
        if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


def mask_text(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """``text`` with every span replaced by ``[KIND]``; the rest stays as it is."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind, _ in find_spans(text, threshold):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def pii_spans(df: DataFrame, keys: list[str], fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row per piece of personal data: keys, field_name, kind, start_pos, end_pos, score.

    One pass without a shuffle; a text equal to an earlier field's text of its row is
    searched once.
    """
    slim = df.select(*keys, *[F.col(f).cast("string").alias(f"__{i}") for i, f in enumerate(fields)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(len(keys) + i).to_pylist() for i in range(len(fields))]
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                done: dict[str, list] = {}
                for k, name in enumerate(fields):
                    t = texts[k][i]
                    if not t:
                        continue
                    if t not in done:
                        done[t] = find_spans(t, threshold)
                    for a, b, kind, score in done[t]:
                        for c, v in zip(out, (i, name, kind, a, b, score)):
                            c.append(v)
            rows = pa.array(out[0], pa.int64())
            cols = [batch.column(k).take(rows) for k in range(len(keys))]
            cols += [pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "field_name", "kind", "start_pos", "end_pos", "score"])

    return slim.mapInArrow(run, f"{schema}, field_name string, kind string, start_pos int, end_pos int, score double")


def mask(column: Column, threshold: float = THRESHOLD) -> Column:
    """Column with personal data replaced by placeholders of its kind."""

    @F.pandas_udf("string")
    def masked(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: mask_text(x, threshold))

    return masked(column)
