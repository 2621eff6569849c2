"""Blocks of HTML pages: headings, paragraphs and tables in document order, with their section path.

Pages become a tree first, so that what has no end tag ends where its parent does. Inline tags join
their neighbours without space, and a paragraph or table in a cell is a block of its own as well.

Defined results: null and empty pages have no blocks. Repeated rows repeat. An empty table gives an
empty result; only key and html are read. Orders may have gaps where a caption went to its table.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import caption_like

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCHEMA = "ord long, block_type string, text string, section_path array<string>, table_rows array<array<string>>, caption string"
#: Elements without content, and which open elements a start tag ends, as browsers do.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset([*HEADINGS, *"p table ul ol dl div pre form section article blockquote hr header footer nav main aside".split()])
_ENDS = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "option": ("option",), "caption": (), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_SILENT = frozenset(("script", "style", "template"))


class Node:
    """An element: its tag and, in order, its child nodes and pieces of text."""

    __slots__ = ("children", "tag")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def walk(self) -> Iterator[Node | str]:
        """Everything below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            at = todo.pop()
            yield at
            if isinstance(at, Node):
                todo.extend(reversed(at.children))

    def texts(self) -> list[str]:
        out, todo = [], list(reversed(self.children))
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                out.append(at)
            elif at.tag not in _SILENT:
                todo.extend(reversed(at.children))
        return out

    def text(self) -> str:
        return "".join(x.strip() for x in self.texts())

    def below(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag in tags]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def _end(self, tags: tuple[str, ...], within: str | None = None) -> None:
        """Ends the innermost open element of these tags, unless one of `within` is open inside of it."""
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                del self.open[depth:]
                return
            if self.open[depth].tag == within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end(("p",), "table")
        if tag in _ENDS:
            # the last end tag left out may be the cell's or the row's
            for ended in reversed(_ENDS[tag]):
                self._end((ended,), "table" if tag in ("tr", "td", "th") else None)
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end((tag,), "table" if tag in ("tr", "td", "th", "p") else None)

    def handle_data(self, data):
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


def new_block(order: int, kind: str, text: str, path: list[str], **more) -> dict:
    return {"order": order, "block_type": kind, "text": text, "section_path": path, "page": None, "from_ocr": False, "table_rows": None, "caption": None} | more


def table_block(order: int, rows: list[list[str]], path: list[str], blocks: list[dict], caption: str | None = None, own: bool = False) -> dict:
    """The block of a table. Without a caption of its own it takes the paragraph before, if that reads like one, out of blocks."""
    if not own and blocks and blocks[-1]["block_type"] == "paragraph" and caption_like(blocks[-1]["text"]):
        caption = blocks.pop()["text"]
    return new_block(order, "table", "\n".join(" | ".join(r) for r in rows), path, table_rows=rows, caption=caption or None)


class Outline:
    """The headings that hold at a place, by level."""

    def __init__(self):
        self.at: dict[int, str] = {}

    def enter(self, level: int, text: str) -> None:
        self.at = {k: v for k, v in self.at.items() if k < level} | {level: text}

    def path(self) -> list[str]:
        return list(self.at.values())


def read_html(html: str) -> tuple[list[dict], list[str]]:
    """Blocks and failures of a page."""
    blocks: list[dict] = []
    failures: list[str] = []
    outline, order = Outline(), 0
    for node in parsed(html).below(*HEADINGS, "p", "table"):
        if node.tag == "table":
            rows = [[c.text() for c in tr.below("td", "th")] for tr in node.below("tr")]
            rows = [r for r in rows if r]
            if not rows:
                failures.append(f"empty_table_at_order_{order}")
                continue
            own = node.below("caption")
            blocks.append(table_block(order, rows, outline.path(), blocks, own[0].text() if own else None, bool(own)))
        else:
            text = node.text()
            if not text:
                continue
            if node.tag in HEADINGS:
                outline.enter(int(node.tag[1]), text)
            blocks.append(new_block(order, "heading" if node.tag in HEADINGS else "paragraph", text, outline.path()))
        order += 1
    return blocks, failures


def all_text(html: str) -> str:
    """Every piece of text of a page, joined by spaces."""
    return " ".join(parsed(html).texts())


def blocks_of(html: str) -> list[list]:
    """[block_type, text, section_path, caption] of each block."""
    return [[b["block_type"], b["text"], b["section_path"], b["caption"]] for b in read_html(html)[0]]


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each block: doc, ord, block_type, text, section_path, table_rows, caption."""
    source = pages.select(F.col(key).alias("doc"), F.col(html).cast("string").alias("html"))
    kind = source.schema["doc"].dataType.simpleString()
    types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = [], []
            for i, page in enumerate(batch.column("html").to_pylist()):
                for b in read_html(page or "")[0]:
                    doc.append(i)
                    rows.append((b["order"], b["block_type"], b["text"], b["section_path"], b["table_rows"], b["caption"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc, pa.int64())), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], ["doc", "ord", "block_type", "text", "section_path", "table_rows", "caption"])

    return source.mapInArrow(run, f"doc {kind}, {SCHEMA}")
