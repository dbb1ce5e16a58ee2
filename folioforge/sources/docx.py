"""Sink and source for word-processor documents, one file for each document.

``blocks`` are rows (doc_id, block_seq, kind, text, cells, n_rows, n_cols), see
operators.documents; the last three, which only tables have, may be missing. A document
is written by the task that has its rows, through Spark, as one row (doc_id, content);
the caller stores the bytes where it likes.

A table's cell spans columns and rows as its colspan and rowspan say; slots that no
cell covers are empty cells. Columns in which no cell starts or ends are one with the column before
them, so the columns follow the cells, however wide the spans are. Word processors take ``MOST_COLUMNS``
columns: a table is written as one table for each so many, from left to right; a cell that goes on in the next has its text in the first.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
_DOCUMENT_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
_STYLES = f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{_W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:next w:val="Normal"/><w:pPr><w:keepNext/><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
_BORDERS = "<w:tblPr><w:tblBorders>" + "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV")) + "</w:tblBorders></w:tblPr>"
MOST_COLUMNS = 63

CELLS = "array<struct<row:int,col:int,text:string,colspan:int,rowspan:int>>"
Cell = tuple[int, int, str, int, int]  # row, column, text, colspan, rowspan


def _paragraph(text: str, font: str, size: int, bold: bool) -> str:
    clean = escape(re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", text))
    lines = '</w:t><w:br/><w:t xml:space="preserve">'.join(clean.split("\n"))
    style = f'<w:rPr><w:rFonts w:ascii="{escape(font)}" w:eastAsia="{escape(font)}"/>{"<w:b/>" * bold}<w:sz w:val="{2 * size}"/></w:rPr>'
    heading = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if bold else ""
    return f'<w:p>{heading}<w:r>{style}<w:t xml:space="preserve">{lines}</w:t></w:r></w:p>'


def _table(cells: Iterable[Cell], n_rows: int, n_cols: int, font: str, size: int) -> Iterator[str]:
    cells = list(cells)
    stop = lambda c: min(c[1] + max(c[3], 1), n_cols)
    edges = sorted({0, n_cols} | {c[1] for c in cells} | {stop(c) for c in cells})
    place = {x: i for i, x in enumerate(edges)}
    by_row: dict[int, list[tuple[int, int, Cell]]] = {}  # the cells of each row, those from above too, with their first and last columns
    for cell in sorted(cells):
        for y in range(cell[0], min(cell[0] + max(cell[4], 1), n_rows)):
            by_row.setdefault(y, []).append((place[cell[1]], place[stop(cell)], cell))
    for left in range(0, len(edges) - 1, MOST_COLUMNS):
        right = min(left + MOST_COLUMNS, len(edges) - 1)
        if left:
            yield "<w:p/>"  # tables that touch would be one
        yield f'<w:tbl>{_BORDERS}<w:tblGrid>{"<w:gridCol/>" * (right - left)}</w:tblGrid>'
        for y in range(n_rows):
            yield f"<w:tr>{''.join(_row(by_row.get(y, []), y, left, right, font, size))}</w:tr>"
        yield "</w:tbl>"


def _row(cells: list[tuple[int, int, Cell]], y: int, left: int, right: int, font: str, size: int) -> Iterator[str]:
    """The cells of a row from column left to right; what lies under a later cell, or under none, is left out or empty."""
    starts = {max(first, left): (first, last, cell) for first, last, cell in cells if first < right and last > left}
    x = left
    while x < right:
        first, last, cell = starts.get(x, (x, x + 1, None))
        wide = min(last, right) - x
        span = f'<w:gridSpan w:val="{wide}"/>' if wide > 1 else ""
        merge = "" if cell is None or cell[4] <= 1 else '<w:vMerge w:val="restart"/>' if cell[0] == y else "<w:vMerge/>"
        text = cell[2] if cell is not None and cell[0] == y and first >= left else ""
        yield f"<w:tc><w:tcPr>{span}{merge}</w:tcPr>{_paragraph(text or '', font, size, False)}</w:tc>"
        x += wide


def write_document(out: IO[bytes], rows: Iterable[tuple], font: str = "SimSun", size: int = 11) -> None:
    """Write a document of (kind, text, cells, n_rows, n_cols) rows in order to a stream, row by row; the last three may be left out."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/_rels/document.xml.rels", _DOCUMENT_RELS), ("word/styles.xml", _STYLES)):
            z.writestr(zipfile.ZipInfo(name), part, zipfile.ZIP_DEFLATED)
        info = zipfile.ZipInfo("word/document.xml")
        info.compress_type = zipfile.ZIP_DEFLATED
        with z.open(info, "w", force_zip64=True) as body:
            body.write(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>'.encode())
            for kind, text, *table in rows:
                if kind == "page_break":
                    body.write(BREAK.encode())
                elif kind == "table" and table and table[0] is not None and len(table[0]):
                    for part in _table(*table, font, size):
                        body.write(part.encode())
                else:
                    body.write(_paragraph(text or "", font, size, kind == "heading").encode())
            body.write(b"</w:body></w:document>")


def document_bytes(rows: Iterable[tuple], font: str = "SimSun", size: int = 11) -> bytes:
    out = io.BytesIO()
    write_document(out, rows, font, size)
    return out.getvalue()


def _text(p: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{{{_W}}}t" else "\n" for x in p.iter() if x.tag in (f"{{{_W}}}t", f"{{{_W}}}br"))


def _cells(table: ElementTree.Element) -> list[Cell]:
    """The cells of a table with their spans; the parts that continue a cell from above lengthen it."""
    found: dict[int, list] = {}  # column to its last cell
    out = []
    for y, tr in enumerate(table.findall(f"{{{_W}}}tr")):
        x = 0
        for tc in tr.findall(f"{{{_W}}}tc"):
            span, merge = tc.find(f".//{{{_W}}}gridSpan"), tc.find(f".//{{{_W}}}vMerge")
            wide = int(span.get(f"{{{_W}}}val", "1")) if span is not None else 1
            if merge is not None and merge.get(f"{{{_W}}}val") != "restart" and x in found:
                found[x][4] += 1
            else:
                found[x] = [y, x, "\n".join(_text(p) for p in tc.findall(f"{{{_W}}}p")), wide, 1]
                out.append(found[x])
            x += wide
    return [tuple(c) for c in out]


def _heading_styles(z: zipfile.ZipFile) -> set[str]:
    """The ids of the paragraph styles that are headings, by name or outline level, also by what they are based on."""
    if "word/styles.xml" not in z.namelist():
        return set()
    found, based = set(), {}
    for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(f"{{{_W}}}style"):
        name, parent = s.find(f"{{{_W}}}name"), s.find(f"{{{_W}}}basedOn")
        based[s.get(f"{{{_W}}}styleId")] = parent.get(f"{{{_W}}}val") if parent is not None else None
        if s.find(f"{{{_W}}}pPr/{{{_W}}}outlineLvl") is not None or (name is not None and re.match("(?i)heading|title", name.get(f"{{{_W}}}val", ""))):
            found.add(s.get(f"{{{_W}}}styleId"))
    for _ in range(len(based)):
        more = {s for s, parent in based.items() if parent in found} - found
        if not more:
            break
        found |= more
    return found


def document_rows(content: bytes) -> list[tuple[str, str, list[Cell] | None]]:
    """(kind, text, cells) rows of a document: headings, paragraphs, list items, images (their part's name), tables and page breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{{{_W}}}body")
        headings = _heading_styles(z)
        rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target", "") for r in rels}
    rows = []
    for part in body if body is not None else []:
        if part.tag == f"{{{_W}}}tbl":
            rows.append(("table", "", _cells(part)))
        elif part.tag == f"{{{_W}}}p":
            images = [x.get(f"{{{_R}}}embed") for x in part.iter(f"{{{_A}}}blip")]
            rows += [("image", targets.get(i, ""), None) for i in images]
            style, text = part.find(f"{{{_W}}}pPr/{{{_W}}}pStyle"), _text(part)
            if any(b.get(f"{{{_W}}}type") == "page" for b in part.iter(f"{{{_W}}}br")):
                rows.append(("page_break", "", None))
            elif style is not None and style.get(f"{{{_W}}}val") in headings:
                rows.append(("heading", text, None))
            elif part.find(f"{{{_W}}}pPr/{{{_W}}}numPr") is not None:
                rows.append(("list_item", text, None))
            elif text or not images:
                rows.append(("paragraph", text, None))
    return rows


def render(blocks: DataFrame, font: str = "SimSun", size: int = 11) -> DataFrame:
    """(doc_id, content) of each document of the blocks."""
    extra = {"cells": CELLS, "n_rows": "int", "n_cols": "int"}
    full = blocks.select("doc_id", "block_seq", "kind", "text", *[F.col(c).cast(t).alias(c) if c in blocks.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_seq")
        rows = []
        for kind, text, cells, n_rows, n_cols in zip(pdf.kind, pdf.text, pdf.cells, pdf.n_rows, pdf.n_cols, strict=True):
            rows.append((kind, text) if cells is None else (kind, text, [(c["row"], c["col"], c["text"], c["colspan"], c["rowspan"]) for c in cells], int(n_rows), int(n_cols)))
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "content": [document_bytes(rows, font, size)]})

    return full.groupBy("doc_id").applyInPandas(one, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, content binary")


def parse(documents: DataFrame) -> DataFrame:
    """(path, block_seq, kind, text, cells) of documents (path, content)."""

    def run(batches):
        for pdf in batches:
            rows = [(d.path, i, kind, text, cells and [dict(zip(("row", "col", "text", "colspan", "rowspan"), c, strict=True)) for c in cells]) for d in pdf.itertuples() for i, (kind, text, cells) in enumerate(document_rows(d.content))]
            yield pd.DataFrame(rows, columns=["path", "block_seq", "kind", "text", "cells"])

    return documents.select("path", "content").mapInPandas(run, f"path string, block_seq int, kind string, text string, cells {CELLS}")
