"""Instructions for models: framework coding, open coding, and both stages of themes.

Everything in them comes from the framework, the codebook or the items given; the wording
around it is this library's. What a model must return is the shape that the operators read.
"""

from __future__ import annotations

import json

from codeloom.framework import UNSPECIFIED, Framework

#: Codes of the book that an instruction lists.
LISTED_CODES = 60
LANGUAGES = {"en": "English", "zh-Hant": "Traditional Chinese"}
CORPUS_TERM = "document"


def analysis_language(wanted: str, script: str) -> str:
    """Language of the answer: the one wanted, or for ``auto`` the one of the text's script (``functions.text.script``); auto where neither tells."""
    return wanted if wanted in LANGUAGES else {"zh": "zh-Hant", "en": "en"}.get(script, "auto")


def language_note(language: str) -> str:
    """What an instruction says about the language of the answer."""
    if language not in LANGUAGES:
        return "Answer in the language of the material. Copy quotations as they are."
    strict = " Traditional characters only, no simplified ones." if language == "zh-Hant" else ""
    return f"Answer in {LANGUAGES[language]}.{strict} Copy quotations as they are, whatever their language."


def _article(term: str) -> str:
    return ("an " if term[:1].lower() in "aeiou" else "a ") + term


def framework_prompt(fw: Framework, language: str = "auto") -> str:
    """Instruction to code a transcript with a framework: its dimensions with indicators and exclusions, the rules, and the JSON to return."""
    term, case = fw.corpus_term("document"), fw.corpus_term("case")
    out = [f"Code {_article(term)} with the framework {fw.name()}.", *filter(None, (fw.citation, fw.description())), language_note(language), "", "# Dimensions"]
    for d in fw.dimensions:
        out += ["", f"## {d.label()} (id {d.id})", *filter(None, (d.definition(),))]
        for p in fw.polarities or (None,):
            out += [f"{p}: {fw.polarity_label(d.id, p)}"] if p else []
            out += [f"- {x}" for x in d.indicators(p)]
        out += [f"Not {d.label()}:", *(f"- {x}" for x in d.exclusions())] if d.exclusions() else []
        out += ["Literature: " + "; ".join(d.literature[:4])] if d.literature else []
    code = {"dimension": " | ".join(d.id for d in fw.dimensions), **({"polarity": " | ".join(fw.polarities)} if fw.polarities else {}), "rationale": "why, in at most 20 words"}
    answer = {
        "respondent": f"the {case} as the {term} names it", "descriptors": {k: " | ".join((*v, UNSPECIFIED)) for k, v in fw.descriptors} | {"descriptor_basis": "the sentence they come from"},
        "segments": [{"title": "what the passage says, no name of a dimension", "quote": "one or two sentences", "full_text": "the passage around them", "codes": [code]}, "..."], "summary": "150 to 200 words"}
    out += [
        "", "# Rules", "- Go through everything from the first line to the last; every passage that shows a dimension is a segment, however many there are.",
        "- One segment may have several codes if it shows several dimensions.", "- What the text does not show is no evidence. What the speaker says is lacking in their world is.",
        "- quote and full_text are copied letter by letter; quote is a part of full_text.", f"- Descriptors only where the {term} states them, else {UNSPECIFIED}.",
        "", "# Answer: JSON of this shape and nothing else", json.dumps(answer, ensure_ascii=False, indent=1)]
    return "\n".join(out)


def codebook_block(codes: list[dict], most: int = LISTED_CODES) -> str:
    """The ``most`` most used codes (label, definition, count), ties by their order, and how many are not shown."""
    ranked = sorted(codes, key=lambda c: -(c.get("count") or 0))
    if not ranked:
        return "The book is empty: every code you need is new."
    lines = [f"- {c['label']} [{c.get('count') or 0}]" + (f": {c['definition']}" if c.get("definition") else "") for c in ranked[:most]]
    return "\n".join([*lines, *([f"({len(ranked) - most} rarer codes are not shown.)"] if len(ranked) > most else [])])


def open_prompt(codes: list[dict], language: str = "auto", term: str | None = None, most: int = LISTED_CODES) -> str:
    """Instruction to code openly with a growing book."""
    term = term or CORPUS_TERM
    code = {"label": "a code of the book letter by letter, or a new one of a few words", "definition": "one sentence if it is new, else empty", "rationale": "why, in at most 20 words"}
    answer = {"respondent": f"the person speaking as the {term} names them", "open_segments": [{"title": "about this passage", "quote": "one or two sentences", "full_text": "the passage around them", "open_codes": [code]}, "..."]}
    return "\n".join([
        f"Code {_article(term)} openly: codes come from the text, no theory is given.", language_note(language), "", "# Book so far", codebook_block(codes, most),
        "", "# Rules", "- Use a code of the book where it fits; make a new one where none does.", "- A code says what the passage does, a little above its words; topics and remarks are no codes.",
        "- Go through everything from the first line to the last.", "- What the text does not say is not coded.", "- quote and full_text are copied letter by letter.",
        "", "# Answer: JSON of this shape and nothing else", json.dumps(answer, ensure_ascii=False, indent=1)])


def theme_prompt(items: list[dict], language: str = "auto") -> str:
    """Stage 1: provisional themes from first-order items (global_id, title, quote, existing_codes)."""
    rows = [f"{x['global_id']} [{', '.join(x.get('existing_codes') or [])}] {x.get('title') or ''}: {x.get('quote') or ''}" for x in items]
    answer = [{"name": "...", "definition": "...", "member_ids": ["G0001"], "polarity_tendency": "..."}]
    return "\n".join(["Group these first-order items into provisional themes. Every theme needs several items; an item may stay alone.", language_note(language), "", *rows, "", "# Answer: JSON of this shape and nothing else", json.dumps(answer)])


def aggregate_prompt(themes: list[dict], fw: Framework, language: str = "auto") -> str:
    """Stage 2: final themes from provisional ones (provisional_id, name, definition), assigned to dimensions."""
    rows = [f"{t['provisional_id']} {t['name']}: {t.get('definition') or ''}" for t in themes]
    answer = [{"name": "...", "definition": "...", "aggregate_dimension": " | ".join([*(d.id for d in fw.dimensions), "unassigned"]), "frame_relation": "aligned | extends | contradicts", "merged_from": ["provisional ids"]}]
    return "\n".join(["Merge these provisional themes into final ones and assign each to a dimension, or to none.", language_note(language), "", *(f"- {d.id}: {d.label()}" for d in fw.dimensions), "", *rows, "", "# Answer: JSON of this shape and nothing else", json.dumps(answer)])
