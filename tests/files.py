"""Small office files made in memory."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return buffer.getvalue()


def docx(body: list) -> bytes:
    """body: ("h", text), ("p", text) or ("t", rows)."""
    out = []
    for kind, content in body:
        if kind == "t":
            rows = "".join(
                "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>"
                for row in content
            )
            out.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = '<w:pPr><w:pStyle w:val="s1"/></w:pPr>' if kind == "h" else ""
            half = len(content) // 2
            runs = "".join(f"<w:r><w:t>{escape(x)}</w:t></w:r>" for x in (content[:half], content[half:]))
            out.append(f"<w:p>{style}{runs}</w:p>")
    return _zip(
        {
            "word/document.xml": f"<w:document {W}><w:body>{''.join(out)}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {W}><w:style w:styleId="s1"><w:name w:val="Heading 1"/></w:style></w:styles>',
        }
    )


def xlsx(sheets: dict[str, list[list]], active: int = 0) -> bytes:
    names = list(sheets)
    strings: list[str] = []
    parts = {}
    for number, name in enumerate(names, 1):
        rows = []
        for r, row in enumerate(sheets[name], 1):
            cells = []
            for c, value in enumerate(row):
                reference = f"{chr(ord('A') + c)}{r}"
                if value is None:
                    continue
                if isinstance(value, str):
                    strings.append(value)
                    cells.append(f'<c r="{reference}" t="s"><v>{len(strings) - 1}</v></c>')
                else:
                    cells.append(f'<c r="{reference}"><v>{value}</v></c>')
            rows.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{number}.xml"] = f"<worksheet {S}><sheetData>{''.join(rows)}</sheetData></worksheet>"
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = (
        f'<workbook {S} {R}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>'
    )
    parts["xl/_rels/workbook.xml.rels"] = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        + "</Relationships>"
    )
    parts["xl/sharedStrings.xml"] = f"<sst {S}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in strings)}</sst>"
    return _zip(parts)


OFFER = docx(
    [
        ("p", "Введение"),
        ("h", "Модели"),
        ("p", "Линейка блендеров МиксерПро."),
        ("t", [["Параметр", "Значение"], ["Мощность", "540 Вт"], ["Артикул", "PMP-540"]]),
        ("h", "Контакты"),
        ("p", "Пишите на a@b.example"),
    ]
)
SPEC = xlsx(
    {
        "Other": [["x"], ["y"]],
        "Spec": [[None, None], ["Артикул", "Мощность", "", "Цвет"], ["KTL-22", 2200, "skip", None], [None], [None, 1.5, None, "белый"]],
    },
    active=1,
)
