"""Coding frameworks as value objects: dimensions with or without polarity.

Nothing is global: operators take the framework (or its tables) as an argument.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

UNASSIGNED, UNASSIGNED_SHORT = "unassigned", "UNC"
UNSPECIFIED, OTHER = "unspecified", "other"


class FrameworkError(ValueError):
    """A framework definition that cannot be used."""


def _frozen(value: object) -> object:
    """Nested lists and objects as tuples, so that value objects stay hashable."""
    if isinstance(value, dict):
        return tuple((k, _frozen(v)) for k, v in value.items())
    return tuple(_frozen(v) for v in value) if isinstance(value, (list, tuple)) else value


def _in(texts: tuple, lang: str, default: object) -> object:
    """What ``texts`` (language, text) hold in ``lang``, else in English, else ``default``."""
    known = dict(texts)
    return known.get(lang) or known.get("en") or default


@dataclass(frozen=True)
class Dimension:
    """A dimension; texts are pairs of language and text, indicators of a polarity (or '') and such pairs of lists."""

    id: str
    short: str
    labels: tuple[tuple[str, str], ...] = ()
    definitions: tuple[tuple[str, str], ...] = ()
    indicator_lists: tuple = ()
    exclusion_lists: tuple = ()
    literature: tuple[str, ...] = ()

    def label(self, lang: str = "en") -> str:
        """Label in ``lang``, else in English, else the id."""
        return _in(self.labels, lang, self.id)

    def definition(self, lang: str = "en") -> str:
        return _in(self.definitions, lang, "")

    def indicators(self, polarity: str | None = None, lang: str = "en") -> tuple[str, ...]:
        """Indicators of a polarity; those of the dimension itself where it has none."""
        return _in(dict(self.indicator_lists).get(polarity or "", ()), lang, ())

    def exclusions(self, lang: str = "en") -> tuple[str, ...]:
        return _in(self.exclusion_lists, lang, ())


@dataclass(frozen=True)
class Framework:
    id: str
    dimensions: tuple[Dimension, ...]
    polarities: tuple[str, ...] = ()
    #: descriptor -> allowed values
    descriptors: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()
    descriptions: tuple[tuple[str, str], ...] = ()
    citation: str = ""
    #: kind (document, case, descriptor_source) -> language -> word
    corpus_terms: tuple = ()
    #: dimension ('' for all) -> polarity -> language -> label
    polarity_labels: tuple = ()

    def name(self, lang: str = "en") -> str:
        return _in(self.names, lang, self.id)

    def description(self, lang: str = "en") -> str:
        return _in(self.descriptions, lang, "")

    def corpus_term(self, kind: str, lang: str = "en") -> str:
        """What the corpus calls its documents and cases."""
        return _in(dict(self.corpus_terms).get(kind, ()), lang, {"document": "interview transcript", "case": "respondent", "descriptor_source": "what respondents say of themselves"}.get(kind, kind))

    def polarity_label(self, dimension: str, polarity: str, lang: str = "en") -> str:
        """Label of a polarity in a dimension, else in general, else the polarity."""
        own = dict(self.polarity_labels)
        return next((x for k in (dimension, "") if (x := _in(dict(own.get(k, ())).get(polarity, ()), lang, ""))), polarity)

    @property
    def has_polarity(self) -> bool:
        return bool(self.polarities)

    @property
    def codes(self) -> tuple[str, ...]:
        """All codes in framework order: SHORT-POLARITY, or SHORT without polarity."""
        return tuple(f"{d.short}-{p}" for d in self.dimensions for p in self.polarities) if self.polarities else tuple(d.short for d in self.dimensions)

    def code_of(self, dimension: str, polarity: str | None = None) -> str | None:
        """Code of a dimension and polarity; null where they name none."""
        short = next((d.short for d in self.dimensions if d.id == dimension), None)
        if short is None or (self.polarities and polarity not in self.polarities):
            return None
        return f"{short}-{polarity}" if self.polarities else short

    def split_code(self, code: str) -> tuple[str | None, str | None]:
        """(dimension, polarity) of a code; nulls where it is none."""
        for d in self.dimensions:
            for p in self.polarities or (None,):
                if code == (f"{d.short}-{p}" if p else d.short):
                    return d.id, p
        return None, None

    @classmethod
    def from_rows(cls, rows: list, framework_id: str) -> Framework:
        """From rows of a ``frameworks`` table."""
        own = sorted((r for r in rows if r.framework_id == framework_id), key=lambda r: r.dim_ord)
        if not own:
            raise FrameworkError(f"no framework {framework_id!r}")
        return cls(framework_id, tuple(Dimension(r.dimension, r.short_code, (("en", r.label_en), ("zh", r.label_zh))) for r in own), tuple(own[0].polarity_values or ()))

    @classmethod
    def from_dict(cls, data: dict) -> Framework:
        """From a JSON definition; raises FrameworkError listing every problem."""
        problems = validate(data)
        if problems:
            raise FrameworkError("; ".join(problems))
        flat = lambda x: _frozen(x) if isinstance(x, dict) else ((("en", _frozen(x)),) if x else ())
        poles = tuple(data.get("polarity", {}).get("values", ()))
        return cls(
            data["id"],
            tuple(
                Dimension(
                    d["id"], d["short"], flat(d.get("labels", {})), flat(d.get("definition")),
                    tuple((p, flat(x)) for p, x in (d.get("indicators", {}).items() if poles and isinstance(d.get("indicators"), dict) else [("", d["indicators"])] if d.get("indicators") else [])),
                    flat(d.get("exclusions")), tuple(d.get("literature", ())))
                for d in data["dimensions"]
            ),
            poles,
            tuple((k, tuple(v)) for k, v in data.get("descriptors", {}).items()),
            flat(data.get("name")), flat(data.get("description")), data.get("citation") or "", tuple((k, flat(v)) for k, v in data.get("corpus_terms", {}).items()),
            tuple((k, tuple((p, flat(x)) for p, x in v.items())) for k, v in data.get("polarity", {}).get("labels", {}).items()),
        )

    @classmethod
    def load(cls, path: str | Path) -> Framework:
        return cls.from_dict(json.loads(Path(path).read_text("utf-8-sig")))

    def to_dict(self) -> dict:
        def texts(pairs: tuple) -> dict:
            return {k: list(v) if isinstance(v, tuple) else v for k, v in pairs}

        def dimension(d: Dimension) -> dict:
            own = {"id": d.id, "short": d.short, "labels": texts(d.labels), "definition": texts(d.definitions), "exclusions": texts(d.exclusion_lists), "literature": list(d.literature)}
            lists = {p: texts(x) for p, x in d.indicator_lists}
            own["indicators"] = lists.get("", lists) if "" in lists else lists
            return {k: v for k, v in own.items() if v or k in ("id", "short", "labels")}

        out: dict = {"id": self.id, "dimensions": [dimension(d) for d in self.dimensions]}
        if self.polarities:
            out["polarity"] = {"values": list(self.polarities)} | ({"labels": {k: {p: texts(x) for p, x in v} for k, v in self.polarity_labels}} if self.polarity_labels else {})
        more = {
            "descriptors": {k: list(v) for k, v in self.descriptors}, "name": texts(self.names), "description": texts(self.descriptions), "citation": self.citation,
            "corpus_terms": {k: texts(v) for k, v in self.corpus_terms}}
        return out | {k: v for k, v in more.items() if v}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), ensure_ascii=False, indent=1), "utf-8")

    def code_table(self, spark: SparkSession) -> DataFrame:
        """(code_ord, code, dimension, polarity): as many rows as the framework has codes."""
        rows = [(i, c, *self.split_code(c)) for i, c in enumerate(self.codes)]
        return spark.createDataFrame(rows, "code_ord int, code string, dimension string, polarity string")


class FrameworkStore:
    """A folder of frameworks, one of which is active."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def list(self) -> list[str]:
        """Ids of the frameworks that can be used."""
        return sorted(f.stem for f in self.folder.glob("*.json") if not _problems_of(f))

    def load(self, framework_id: str) -> Framework:
        if not (self.folder / f"{framework_id}.json").exists():
            raise FrameworkError(f"no framework {framework_id!r}")
        if problems := _problems_of(self.folder / f"{framework_id}.json"):
            raise FrameworkError("; ".join(problems))
        return Framework.load(self.folder / f"{framework_id}.json")

    def save(self, fw: Framework) -> None:
        """Write a framework; one that could not be read again is refused."""
        Framework.from_dict(fw.to_dict()).save(self.folder / f"{fw.id}.json")

    def copy(self, framework_id: str, new_id: str) -> Framework:
        """A copy under an id that is not taken."""
        if (self.folder / f"{new_id}.json").exists():
            raise FrameworkError(f"{new_id!r} exists")
        fw = replace(self.load(framework_id), id=new_id)
        self.save(fw)
        return fw

    def activate(self, framework_id: str) -> Framework:
        fw = self.load(framework_id)
        (self.folder / "active").write_text(framework_id, "utf-8")
        return fw

    def active(self) -> Framework:
        """The active framework, else the first one."""
        marker = self.folder / "active"
        known = self.list()
        name = marker.read_text("utf-8").strip() if marker.exists() else ""
        if not known:
            raise FrameworkError("the folder holds no framework")
        return self.load(name if name in known else known[0])


def _problems_of(path: Path) -> list[str]:
    try:
        data = json.loads(path.read_text("utf-8-sig"))
    except ValueError as e:
        return [str(e)]
    return validate(data) if isinstance(data, dict) else ["no object"]


def validate(data: dict) -> list[str]:
    """Problems of a definition; empty if it can be used."""
    out: list[str] = []
    dims = data.get("dimensions") or []
    if not re.fullmatch(r"[a-z][a-z0-9_]*", str(data.get("id") or "")):
        out.append("id must be lower-case letters, digits and underscores")
    if not dims:
        out.append("no dimensions")
    ids, shorts = [str(d.get("id") or "") for d in dims], [str(d.get("short") or "") for d in dims]
    out += [f"bad dimension id {x!r}" for x in ids if not re.fullmatch(r"[a-z][a-z0-9_]*", x)]
    out += [f"bad short code {x!r}" for x in shorts if not re.fullmatch(r"[A-Z][A-Z0-9]*", x)]
    out += ["dimension ids repeat"] * (len(set(ids)) < len(ids)) + ["short codes repeat"] * (len(set(shorts)) < len(shorts))
    if UNASSIGNED in ids or UNASSIGNED_SHORT in shorts:
        out.append("a reserved name is used")
    polarity = data.get("polarity")
    if polarity is not None:
        values = polarity.get("values") or []
        if len(values) < 2:
            out.append("polarity needs two values")
        if len(set(values)) < len(values):
            out.append("polarity values repeat")
    for k, v in (data.get("descriptors") or {}).items():
        if not v:
            out.append(f"descriptor {k!r} has no values")
    return out


def slug(name: str) -> str:
    """An id from a free name."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.lower())).strip("_") or "framework"


def short_code(name: str, taken: tuple[str, ...] = ()) -> str:
    """A three-letter code from a name, numbered where it is taken."""
    base = (re.sub(r"[^A-Za-z]", "", name) or "DIM")[:3].upper()
    return next(c for c in (base, *(f"{base}{i}" for i in range(2, 1000))) if c not in taken)
