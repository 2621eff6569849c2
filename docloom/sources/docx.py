"""Blocks of DOCX files, from their XML parts; and a small writer for such files."""

from __future__ import annotations

import io
import zipfile
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from docloom.sources.html import Outline, new_block, table_block

#: Fixed value: the namespace of the format's main parts.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Elements of a run that stand for a character.
_CHARACTERS = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}


def _paragraph_text(p: ElementTree.Element) -> str:
    out = []
    for run in p.iter(_W + "r"):
        for x in run:
            out.append((x.text or "") if x.tag == _W + "t" else _CHARACTERS.get(x.tag, ""))
    return "".join(out)


def _cell_text(cell: ElementTree.Element) -> str:
    return "\n".join(_paragraph_text(p) for p in cell.findall(_W + "p"))


def _rows(table: ElementTree.Element) -> list[list[str]]:
    """Texts of all cells; a merged cell's text stands at each place that it covers."""
    rows: list[list[str]] = []
    for tr in table.findall(_W + "tr"):
        row: list[str] = []
        for cell in tr.findall(_W + "tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = _cell_text(cell)
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and rows and len(rows[-1]) > len(row):
                text = rows[-1][len(row)]
            row += [text] * (int(span.get(_W + "val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


@lru_cache(8)
def _styles(part: bytes) -> dict[str, str]:
    """The names of paragraph styles by id; files of one origin have the same part."""
    styles = {}
    for style in ElementTree.fromstring(part).iter(_W + "style"):
        name = style.find(_W + "name")
        styles[style.get(_W + "styleId", "")] = name.get(_W + "val", "") if name is not None else ""
    return styles


def opened(data: bytes) -> tuple[ElementTree.Element, dict[str, str]]:
    """The body, and the names of paragraph styles by id."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(_W + "body")
        if body is None:
            raise ValueError("the document has no body")
        return body, _styles(parts.read("word/styles.xml")) if "word/styles.xml" in parts.namelist() else {}


def read_docx(data: bytes) -> tuple[list[dict], list[str]]:
    """Blocks and failures of a file, in the order of its body; raises where it is no such file."""
    body, styles = opened(data)
    blocks: list[dict] = []
    failures: list[str] = []
    outline, order = Outline(), 0
    for x in body:
        if x.tag == _W + "p":
            text = _paragraph_text(x).strip()
            if not text:
                continue
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else styles.get(style.get(_W + "val", ""), style.get(_W + "val", "")).lower()
            kind = "heading" if name.startswith("heading") else "paragraph"
            if kind == "heading":
                outline.enter(int("".join(filter(str.isdigit, name)) or 1), text)
            blocks.append(new_block(order, kind, text, outline.path()))
        elif x.tag == _W + "tbl":
            rows = [[c.strip() for c in r] for r in _rows(x)]
            if not any(map(any, rows)):
                failures.append(f"empty_table_at_order_{order}")
                continue
            blocks.append(table_block(order, rows, outline.path(), blocks))
        else:
            continue
        order += 1
    return blocks, failures


def all_text(data: bytes) -> str:
    """All paragraphs, then all rows of tables with cells joined by spaces."""
    body, _ = opened(data)
    lines = [_paragraph_text(p) for p in body.findall(_W + "p")]
    return "\n".join(lines + [" ".join(r) for t in body.findall(_W + "tbl") for r in _rows(t)])


def write_docx(items: list) -> bytes:
    """A file of items: text, (heading level, text), or the rows of a table."""
    shown = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    xml = []
    for x in items:
        if isinstance(x, str):
            xml.append(f"<w:p>{shown(x)}</w:p>")
        elif isinstance(x, tuple):
            xml.append(f'<w:p><w:pPr><w:pStyle w:val="H{x[0]}"/></w:pPr>{shown(x[1])}</w:p>')
        else:
            xml.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{shown(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in x) + "</w:tbl>")
    ns = f'xmlns:w="{_W[1:-1]}"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as parts:
        # a fixed date, so that equal items give equal bytes
        for name, text in (
            ("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'),
            ("word/styles.xml", f"<w:styles {ns}>" + "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 10)) + "</w:styles>"),
            ("word/document.xml", f"<w:document {ns}><w:body>{''.join(xml)}</w:body></w:document>"),
        ):
            parts.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()
