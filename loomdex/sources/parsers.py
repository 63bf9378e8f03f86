"""File bytes -> blocks. One function per format, run inside Spark tasks.

docx and xlsx are zipped XML and need only the standard library; for pdf the caller
supplies a reader of pages (see ``page_blocks``). A parser returns ``(kind, content, page, section, rows)``
tuples in document order; table rows become text in the plan, not here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

Block = tuple[str, str, int, str, list[list[str]] | None]

# XML namespaces, heading style names, the section of a
# specification sheet, and the error text of a scan.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADING_STYLES = ("heading", "заголовок")
SHEET_SECTION = "Спецификация"
NO_TEXT_LAYER = "no text layer"


class NoTextLayer(Exception):
    """A pdf of images only."""


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    marks = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
    return "".join(n.text or "" if n.tag == W + "t" else marks.get(n.tag, "") for n in paragraph.iter())


def _table_rows(table: ElementTree.Element) -> list[list[str]]:
    """Cell texts by grid column: a merged cell counts once per column it spans,
    and a cell continued from above repeats the text above."""
    rows: list[list[str]] = []
    for row in table.findall(W + "tr"):
        cells: list[str] = []
        for cell in row.findall(W + "tc"):
            text = "\n".join(_paragraph_text(p) for p in cell.findall(W + "p")).strip()
            span = cell.find(f"{W}tcPr/{W}gridSpan")
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(W + "val") != "restart" and rows:
                text = rows[-1][len(cells)] if len(cells) < len(rows[-1]) else text
            cells += [text] * (int(span.get(W + "val", "1")) if span is not None else 1)
        rows.append(cells)
    return rows


def parse_docx(data: bytes) -> list[Block]:
    """All paragraphs, then all tables; a table belongs to the last section."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _xml(archive, "word/document.xml").find(W + "body")
        styles = _xml(archive, "word/styles.xml")
    names = {}
    for style in styles.iter(W + "style") if styles is not None else ():
        name = style.find(W + "name")
        if name is not None:
            names[style.get(W + "styleId")] = name.get(W + "val", "")
    blocks: list[Block] = []
    section = ""
    for paragraph in body.findall(W + "p"):
        text = _paragraph_text(paragraph).strip()
        if not text:
            continue
        reference = paragraph.find(f"{W}pPr/{W}pStyle")
        style_id = reference.get(W + "val") if reference is not None else None
        style = names.get(style_id, style_id or "").lower()
        if any(word in style for word in HEADING_STYLES):
            section = text
        blocks.append(("text", text, 1, section, None))
    for table in body.findall(W + "tbl"):
        rows = _table_rows(table)
        blocks.append(("table", "", 1, section, rows))
    return blocks


def _column(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _sheet_path(archive: zipfile.ZipFile, sheet: str | None) -> str:
    book = _xml(archive, "xl/workbook.xml")
    sheets = list(book.iter(S + "sheet"))
    view = book.find(f"{S}bookViews/{S}workbookView")
    active = int(view.get("activeTab", "0")) if view is not None else 0
    chosen = sheets[active] if sheet is None else next(s for s in sheets if s.get("name") == sheet)
    for link in _xml(archive, "xl/_rels/workbook.xml.rels"):
        if link.get("Id") == chosen.get(R + "id"):
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise KeyError(chosen.get("name"))


def _cell_value(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t")).strip()
    value = cell.find(S + "v")
    raw = (value.text or "") if value is not None else ""
    if cell.get("t") == "s":
        return shared[int(raw)].strip()
    if cell.get("t") == "b":
        return "True" if raw == "1" else "False"
    if cell.get("t", "n") == "n" and re.search(r"[.eE]", raw):
        return str(float(raw))
    return raw.strip()


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """Cells of the active or the named sheet as stripped text."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        strings = _xml(archive, "xl/sharedStrings.xml")
        shared = []
        if strings is not None:
            shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in strings.findall(S + "si")]
        grid = _xml(archive, _sheet_path(archive, sheet))
    rows = []
    for row in grid.iter(S + "row"):
        cells = {}
        for position, cell in enumerate(row.findall(S + "c")):
            reference = cell.get("r")
            cells[_column(reference) if reference else position] = _cell_value(cell, shared)
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def parse_xlsx(data: bytes, sheet: str | None = None) -> list[Block]:
    """The non-empty rows of a sheet as one block; its lines are built in the plan."""
    filled = [row for row in sheet_rows(data, sheet) if any(row)]
    return [("sheet", "", 1, SHEET_SECTION, filled)] if len(filled) > 1 else []


def page_blocks(pages: Iterable[tuple[str, list[list[list[str | None]]]]]) -> list[Block]:
    """Blocks of paged formats: ``pages`` yields a text and tables of cells for each
    page, as a caller's reader finds them; paragraphs are cut in the plan."""
    blocks: list[Block] = []
    for number, (text, tables) in enumerate(pages, start=1):
        texts = [("page", text, number, "", None)] if text.strip() else []
        blocks += texts + [("table", "", number, "", [[(c or "").strip() for c in row] for row in t]) for t in tables]
    if not blocks:
        raise NoTextLayer(NO_TEXT_LAYER)
    return blocks


PARSERS: dict[str, Callable[[bytes], list[Block]]] = {"docx": parse_docx, "xlsx": parse_xlsx}
