"""Transcripts in Word files: body text, marked text, and per-file errors; standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: Deleted and moved-away text, compatibility copies and text boxes are not read.
_SKIP = {f"{W}del", f"{W}moveFrom", f"{W}delText", f"{W}txbxContent", f"{W}pict", f"{W}instrText", f"{_MC}Fallback"}


def _texts(node: ET.Element) -> Iterator[str]:
    for child in node:
        if child.tag in _SKIP:
            continue
        if child.tag == f"{W}t":
            yield child.text or ""
        elif child.tag == f"{W}tab":
            yield "\t"
        elif child.tag in (f"{W}br", f"{W}cr"):
            yield "\n"
        else:
            yield from _texts(child)


def _cell(tc: ET.Element) -> str:
    return "\n".join(x for x in ("".join(_texts(p)).strip() for p in tc.iter(f"{W}p")) if x)


def _table(tbl: ET.Element) -> Iterator[str]:
    for tr in tbl.iter(f"{W}tr"):
        cells = [_cell(tc) for tc in tr.findall(f"{W}tc")]
        if len(cells) == 2 and 0 < len(cells[0]) <= 40 and "\n" not in cells[0] and cells[1]:
            yield f"【{cells[0].rstrip(':：')}】{cells[1]}"
        elif any(cells):
            yield "\t".join(cells)


def _blocks(node: ET.Element) -> Iterator[str]:
    for child in node:
        if child.tag == f"{W}p":
            yield "".join(_texts(child))
        elif child.tag == f"{W}tbl":
            yield from _table(child)
        elif child.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins", f"{W}moveTo", f"{W}customXml"):
            yield from _blocks(child)


def docx_text(data: bytes) -> str:
    """Body paragraphs and tables in document order. Headers, footers and notes are no part of it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    return "\n".join(_blocks(body)) if body is not None else ""


def docx_marks(data: bytes) -> list[tuple[int, int, str, str | None]]:
    """(start, end, text, comment) of commented or highlighted runs over the plain paragraphs' text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        notes = {}
        if "word/comments.xml" in z.namelist():
            for c in ET.fromstring(z.read("word/comments.xml")).iter(f"{W}comment"):
                notes[c.get(f"{W}id")] = "".join(_texts(c))
    at, text, open_, out = 0, [], {}, []
    lit: int | None = None
    for p in body.iter(f"{W}p") if body is not None else ():
        for node in p.iter():
            if node.tag == f"{W}commentRangeStart":
                open_[node.get(f"{W}id")] = at
            elif node.tag == f"{W}commentRangeEnd" and node.get(f"{W}id") in open_:
                start = open_.pop(node.get(f"{W}id"))
                out.append((start, at, "".join(text)[start:at], notes.get(node.get(f"{W}id"))))
            elif node.tag == f"{W}r":
                shown = node.find(f"{W}rPr/{W}highlight") is not None
                if shown and lit is None:
                    lit = at
                elif not shown and lit is not None:
                    out.append((lit, at, "".join(text)[lit:at], None))
                    lit = None
                piece = "".join(_texts(node))
                text.append(piece)
                at += len(piece)
        if lit is not None:
            out.append((lit, at, "".join(text)[lit:at], None))
            lit = None
        text.append("\n")
        at += 1
    commented = [(a, b) for a, b, _, c in out if c is not None]
    return sorted(x for x in out if x[3] is not None or not any(a < x[1] and x[0] < b for a, b in commented))


#: Bracket tags a reader may write into the text, like [REF-N].
INLINE = re.compile(r"\[([A-Z][A-Z0-9]*(?:-[A-Z]+)?(?:\s*[,+/]\s*[A-Z][A-Z0-9]*(?:-[A-Z]+)?)*)\]")


def inline_tags(text: str) -> list[tuple[int, list[str]]]:
    """(position, codes) of bracket tags."""
    return [(m.start(), re.split(r"\s*[,+/]\s*", m.group(1))) for m in INLINE.finditer(text)]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of every .docx and .txt file; a file that cannot be read keeps its row with the error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,txt}").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    texts.append(data.decode("utf-8-sig") if name.lower().endswith(".txt") else docx_text(data))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.mapInArrow(run, "path string, text string, error string")


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Highlight colours a Word file knows, one per dimension in order.
COLOURS = ("yellow", "green", "cyan", "magenta", "blue", "red", "darkYellow", "darkGreen", "darkCyan", "darkMagenta", "darkBlue", "darkRed", "lightGray", "darkGray")


_WP = W[1:-1]


def package(body: str, comments: str = "") -> bytes:
    """A Word file from the XML of its body and of its comments."""
    parts = {"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WP}"><w:body>{body}</w:body></w:document>'}
    if comments:
        kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
        parts["[Content_Types].xml"] = _TYPES.replace("</Types>", f'<Override PartName="/word/comments.xml" ContentType="{kind}"/></Types>')
        relation = '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments" Target="comments.xml"/>'
        parts["word/_rels/document.xml.rels"] = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relation}</Relationships>'
        parts["word/comments.xml"] = f'{_HEAD}<w:comments xmlns:w="{_WP}">{comments}</w:comments>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_docx(text: str, pieces: list[tuple[int, int, str]] | None = None, comments: list[tuple[int, int, str]] | None = None) -> bytes:
    """A Word file of ``text``; ``pieces`` (start, end, colour) are highlighted, ``comments`` (start, end, comment) stand beside.

    Where pieces overlap the one that starts first has the colour.
    """
    from xml.sax.saxutils import escape

    colours, notes = sorted(pieces or []), sorted(comments or [])
    # The text changes its looks only at these places; a line is the runs between them.
    edges = sorted({0, len(text), *(x for a, b, _ in (*colours, *notes) for x in (a, b))} | {m.start() for m in re.finditer("\n", text)} | {m.end() for m in re.finditer("\n", text)})
    begins = {a: [i for i, n in enumerate(notes) if n[0] == a] for a, _, _ in notes}
    ends = {b: [i for i, n in enumerate(notes) if n[1] == b] for _, b, _ in notes}
    lines: list[list[str]] = [[]]
    for at, to in zip(edges, [*edges[1:], len(text)]):
        lines[-1] += [f'<w:commentRangeEnd w:id="{i}"/><w:r><w:commentReference w:id="{i}"/></w:r>' for i in ends.get(at, []) if notes[i][0] < at]
        lines[-1] += [f'<w:commentRangeStart w:id="{i}"/>' for i in begins.get(at, []) if notes[i][1] > at]
        run = text[at:to]
        if run == "\n":
            lines.append([])
        elif run:
            colour = next((c for a, b, c in colours if a <= at < b), None)
            look = f'<w:rPr><w:highlight w:val="{colour}"/></w:rPr>' if colour else ""
            lines[-1].append(f'<w:r>{look}<w:t xml:space="preserve">{escape(run)}</w:t></w:r>')
    beside = "".join(f'<w:comment w:id="{i}" w:author="codeloom"><w:p><w:r><w:t xml:space="preserve">{escape(c)}</w:t></w:r></w:p></w:comment>' for i, (a, b, c) in enumerate(notes) if a < b)
    return package("".join(f"<w:p>{''.join(x)}</w:p>" for x in lines), beside)


def strip_tags(text: str) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """A text without its bracket tags, and (start, end, codes) of the sentence or line each stood behind, in the text without tags."""
    plain, marks, at = "", [], 0
    for where, codes in inline_tags(text):
        plain += text[at:where].rstrip(" ") if text[where - 1 : where] == " " else text[at:where]
        end = len(plain.rstrip())
        start = max(plain.rfind("\n", 0, end) + 1, max((m.end() for m in re.finditer(r"[.!?。！？]+[\s”’」』\"]*", plain[: max(end - 1, 0)])), default=0))
        marks.append((min(start, end), end, codes))
        at = INLINE.match(text, where).end()
    return plain + text[at:], marks
