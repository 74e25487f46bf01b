"""Reports: a workbook of the analysis tables, a Word report, and archives of files.

The tables of a report are aggregates (codes, respondents, tests); a sheet takes as many
rows as the format has, beyond which the report is refused and ``export.write_tables`` is
the way. Files are written with the standard library alone.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import cooccur, crosstab, longtable
from codeloom.sources import docx, export

#: Fixed values of the workbook format: rows of a sheet, characters of its name and of a cell.
MAX_ROWS, MAX_NAME, MAX_CELL = 1_048_576, 31, 32_767
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _cell(ref: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        text = ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text)[:MAX_CELL])}</t></is></c>'
    return f'<c r="{ref}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else ""


def sheet_names(names: list[str]) -> list[str]:
    """Names a workbook allows: without its signs, at most 31 characters, each once in any case."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:MAX_NAME] or "sheet"
        pick, n = base, 2
        while pick.lower() in (x.lower() for x in out):
            pick, n = f"{base[: MAX_NAME - len(str(n)) - 1]}_{n}", n + 1
        out.append(pick)
    return out


def write_xlsx(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of (columns, rows) per sheet; null cells are empty."""
    names = sheet_names(list(sheets))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>",
    }
    for i, (columns, rows) in enumerate(sheets.values(), 1):
        lines = (f'<row r="{k}">{"".join(_cell(f"{_column(j)}{k}", v) for j, v in enumerate(row))}</row>' for k, row in enumerate([tuple(columns), *rows], 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    return archive({k: (_HEAD + v).encode() for k, v in parts.items()})


def read_xlsx(data: bytes) -> dict[str, list[list[str]]]:
    """Rows of every sheet as text, with inline or shared strings; a filled coding sheet comes in this form, too."""
    import xml.etree.ElementTree as ET

    m, r = f"{{{_MAIN}}}", f"{{{_REL}}}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{m}t"))
        shared = [text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            rows = []
            for row in ET.fromstring(z.read("xl/" + targets[sheet.get(f"{r}id")].removeprefix("/xl/"))).iter(f"{m}row"):
                cells: dict[int, str] = {}
                for c in row.findall(f"{m}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]+", c.get("r") or _column(len(cells))).group():
                        at = at * 26 + ord(ch) - 64
                    v = c.findtext(f"{m}v")
                    cells[at - 1] = text(c) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v else v or ""
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out[sheet.get("name")] = rows
        return out


def archive(files: dict[str, bytes]) -> bytes:
    """A zip of files; of one name twice the later."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def report_tables(records: DataFrame, frameworks: DataFrame, descriptors: list[str]) -> dict[str, DataFrame]:
    """The tables of an analysis report by name: long form, provenance, endpoints, tests, coverage, descriptors, cross tables, co-occurrence, cases, polarity, codes."""
    latest = longtable.first_rows(records)
    long = longtable.build_long(latest, frameworks)
    of = lambda d: F.coalesce(F.nullif(F.try_element_at("descriptors", F.lit(d)), F.lit("")), F.lit("unspecified")).alias(d)
    wide = long.withColumns({d: of(d) for d in descriptors}) if "descriptors" in long.columns else long
    codes = long.select("code").filter("code is not null").distinct()
    rows = longtable.framework_rows(frameworks)
    reference = frameworks.select("framework_id", "dim_ord", "dimension", "short_code", "label_en", "label_zh", F.array_join("polarity_values", ", ").alias("polarities"))
    out = {
        "long": long.select(*[c for c in ("record_id", "respondent", "framework_id", "seg_pos", "segment_id", "dimension", "polarity", "code", "status", "source") if c in long.columns]),
        "provenance": export.provenance(latest), "endpoints": export.endpoint_rows(latest), "coverage": longtable.coverage(latest, long), "codes": reference.orderBy("framework_id", "dim_ord"),
        "cooccurrence_segment": cooccur.cooccurrence(long, ["record_id", "seg_pos"]), "cooccurrence_case": cooccur.cooccurrence(long.filter("respondent is not null"), ["respondent"]),
        "case_matrix": crosstab.case_matrix(long, codes), "case_matrix_pct": crosstab.case_matrix(long, codes, by_percent=True),
    }
    if descriptors and "descriptors" in long.columns:
        out["tests"] = crosstab.with_p(crosstab.test_sweep(wide, descriptors, ["code", "dimension", "polarity"]))
        out["descriptors"] = latest.select("record_id", "respondent", *map(of, descriptors))
        for d in descriptors:
            out[f"crosstab_{d}"] = crosstab.percent(crosstab.crosstab(wide, d, "dimension"))
    for pole in {tuple(r.polarity_values) for r in rows if r.polarity_values and len(r.polarity_values) == 2}:
        own = [r.framework_id for r in rows if tuple(r.polarity_values or ()) == pole]
        out[f"polarity_{'_'.join(pole)}"] = crosstab.polarity_balance(long.filter(F.col("framework_id").isin(own)), *pole)
    return out


def _collected(df: DataFrame, most: int) -> tuple[list[str], list[tuple]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    return df.columns, [tuple(r) for r in rows]


def workbook(tables: dict[str, DataFrame], most: int = MAX_ROWS - 1) -> bytes:
    """A workbook with one sheet per table; a table of more than ``most`` rows is refused."""
    return write_xlsx({name: _collected(df, most) for name, df in tables.items()})


def word_report(title: str, sections: list[tuple[str, str | DataFrame]], most: int = 500) -> bytes:
    """A Word report: headings with text or a table each; a table of more than ``most`` rows is refused."""
    run = lambda t, bold=False: f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(_CONTROL.sub("", t))}</w:t></w:r>'
    paragraph = lambda t, bold=False: f"<w:p>{run(t, bold)}</w:p>"
    body = [paragraph(title, True)]
    for heading, content in sections:
        body.append(paragraph(heading, True))
        if isinstance(content, str):
            body += [paragraph(t) for t in content.split("\n")]
            continue
        columns, rows = _collected(content, most)
        shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
        cells = lambda row, bold=False: "<w:tr>" + "".join(f"<w:tc>{paragraph(shown(v), bold)}</w:tc>" for v in row) + "</w:tr>"
        body.append(f'<w:tbl><w:tblPr/>{cells(columns, True)}{"".join(map(cells, rows))}</w:tbl>' + paragraph(""))
    return docx.package("".join(body))


def marked_docx(text: str, pieces: list[tuple[int, int, str, str]], legend: dict[str, str] | None = None) -> bytes:
    """A Word file with pieces (start, end, colour, comment) highlighted and commented, after a legend (label, colour)."""
    lines = list((legend or {}).items())
    head = "".join(f"{label}\n" for label, _ in lines)
    marks = [(sum(len(x) + 1 for x, _ in lines[:i]), sum(len(x) + 1 for x, _ in lines[:i]) + len(label), colour, "") for i, (label, colour) in enumerate(lines)]
    return docx.write_docx(head + text, [(a, b, c) for a, b, c, _ in marks] + [(a + len(head), b + len(head), c) for a, b, c, _ in pieces], [(a + len(head), b + len(head), note) for a, b, _, note in pieces if note])


def comparison_files(name: str, text: str, human: list[tuple[int, int, str, str]], model: list[tuple[int, int, str, str]], tables: dict[str, tuple[list[str], list[tuple]]], legend: dict[str, str] | None = None) -> bytes:
    """Side by side: an archive of the text as a person marked it, as the model did, without marks, and the workbook of the comparison."""
    return archive({f"{name}_human.docx": marked_docx(text, human, legend), f"{name}_model.docx": marked_docx(text, model, legend), f"{name}_blank.docx": docx.write_docx(text), f"{name}_comparison.xlsx": write_xlsx(tables)})
