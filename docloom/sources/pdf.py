"""A small PDF reader: text spans with their places and sizes, page by page, and ruled tables.

It reads files with plain objects, Flate or unfiltered streams and simple fonts. Encrypted files and
those whose objects lie in object streams raise ValueError.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9*]?", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: The width of a character as a part of its size, where a font's own widths are not read.
WIDTH = 0.5


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, b"" if x in (b"\n", b"\r") else x)

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.DOTALL).decode("cp1252", "replace")


class PdfFile:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise ValueError("encrypted files are not read")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        self.pages: list[bytes] = []
        roots = [x for x in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", x)]
        if not roots:
            raise ValueError("no catalog among the plain objects")
        self._collect(self._refs(roots[0], b"Pages")[:1], b"", set())

    def _refs(self, x: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", x)
        return [int(r) for r in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def _collect(self, refs: list[int], box: bytes, seen: set[int]) -> None:
        for r in refs:
            if r in seen or r not in self.objects:
                continue
            seen.add(r)
            x = self.objects[r]
            own = re.search(rb"/MediaBox\s*\[[^\]]*\]", x)
            held = own[0] if own else box
            if re.search(rb"/Type\s*/Pages\b", x):
                self._collect(self._refs(x, b"Kids"), held, seen)
            else:
                self.pages.append(x if own else x + held)

    def _stream(self, ref: int) -> bytes:
        x = self.objects.get(ref, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", x, re.DOTALL)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in x[: m.start()] else m[1]

    def page(self, index: int) -> dict:
        """width, spans (block, line, span, text, size, x0, y0, x1, y1 from the top) and lines drawn (x0, y0, x1, y1)."""
        x = self.pages[index]
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", x)
        left, low, right, top = (float(v) for v in box[1].split()) if box else (0.0, 0.0, 612.0, 792.0)
        spans, rules, held = [], [], []
        size = leading = 0.0
        line_at = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        pen = (0.0, 0.0)
        block = -1

        def show(text: str) -> None:
            nonlocal at
            a, b, _, d, e, f = at
            tall = size * abs(d or b or 1.0)
            wide = len(text) * WIDTH * size * abs(a or 1.0)
            if text:
                spans.append((max(block, 0), len(spans), 0, text, round(tall, 3), e - left, top - f - tall, e - left + wide, top - f))
            at = (a, b, at[2], d, e + wide, f)

        def move(tx: float, ty: float) -> None:
            nonlocal at, line_at
            a, b, c, d, e, f = line_at
            line_at = at = (a, b, c, d, e + tx * a + ty * c, f + tx * b + ty * d)

        for m in _TOKEN.finditer(b"\n".join(self._stream(r) for r in self._refs(x, b"Contents"))):
            t = m[0]
            if t[:1] in b"(<[]/" or re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
                held.append(t)
                continue
            numbers = [float(v) for v in held if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", v)]
            words = [_string(v) for v in held if v[:1] in b"(<"]
            if t == b"BT":
                line_at = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                block += 1
            elif t == b"Tf" and numbers:
                size = numbers[-1]
            elif t == b"TL" and numbers:
                leading = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                leading = -numbers[-1] if t == b"TD" else leading
                move(*numbers[-2:])
            elif t == b"Tm" and len(numbers) >= 6:
                line_at = at = tuple(numbers[-6:])
            elif t in (b"T*", b"'", b'"'):
                move(0.0, -leading)
                if t != b"T*" and words:
                    show(words[-1])
            elif t in (b"Tj", b"TJ"):
                show("".join(words))
            elif t == b"m" and len(numbers) >= 2:
                pen = tuple(numbers[-2:])
            elif t == b"l" and len(numbers) >= 2:
                rules.append((pen[0] - left, top - pen[1], numbers[-2] - left, top - numbers[-1]))
                pen = tuple(numbers[-2:])
            elif t == b"re" and len(numbers) >= 4:
                px, py, w, h = numbers[-4:]
                rules += [(px - left, top - y, px + w - left, top - y) for y in (py, py + h)] + [(v - left, top - py, v - left, top - py - h) for v in (px, px + w)]
            held = []
        return {"width": right - left, "spans": spans, "rules": rules}


#: How far rules may miss each other, in points.
REACH = 1.0


def ruled_tables(page: dict) -> list[dict]:
    """The grids that horizontal and vertical rules make where they meet, each with the texts in its cells.

    Rules that meet, directly or by others, are one grid. One of fewer than two columns or rows, as a frame, is none.
    """
    flat = [(min(x0, x1), max(x0, x1), y0) for x0, y0, x1, y1 in page["rules"] if abs(y0 - y1) < 0.5 <= abs(x0 - x1)]
    steep = [(min(y0, y1), max(y0, y1), x0) for x0, y0, x1, y1 in page["rules"] if abs(x0 - x1) < 0.5 <= abs(y0 - y1)]
    root = list(range(len(flat) + len(steep)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (x0, x1, y) in enumerate(flat):
        for j, (y0, y1, x) in enumerate(steep, len(flat)):
            if x0 - REACH <= x <= x1 + REACH and y0 - REACH <= y <= y1 + REACH:
                root[find(i)] = find(j)
    out = []
    for r in sorted({find(i) for i in range(len(root))}):
        across = sorted({round(y, 1) for i, (_, _, y) in enumerate(flat) if find(i) == r})
        down = sorted({round(x, 1) for j, (_, _, x) in enumerate(steep, len(flat)) if find(j) == r})
        if len(across) < 3 or len(down) < 3:
            continue
        rows = [["" for _ in down[1:]] for _ in across[1:]]
        for _, _, _, text, _, x0, y0, x1, y1 in page["spans"]:
            y = (y0 + y1) / 2
            row = next((i for i, (a, b) in enumerate(zip(across, across[1:])) if a <= y < b), None)
            column = next((i for i, (a, b) in enumerate(zip(down, down[1:])) if a <= x0 < b), None)
            if row is not None and column is not None:
                rows[row][column] = f"{rows[row][column]} {text}".strip()
        out.append({"x0": down[0], "y0": across[0], "x1": down[-1], "y1": across[-1], "rows": rows})
    return sorted(out, key=lambda t: (t["y0"], t["x0"]))


def write_pdf(pages: list[dict]) -> bytes:
    """A file of pages: texts (size, x, y from the top, text) and lines (x0, y0, x1, y1 from the top); for examples and tests."""
    objects, kids = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"], []
    for page in pages:
        drawn = [f"{a} {792 - b} m {c} {792 - d} l S" for a, b, c, d in page.get("lines", ())]
        for size, x, y, text in page.get("texts", ()):
            quoted = re.sub(r"([\\()])", r"\\\1", text)
            drawn.append(f"BT /F1 {size} Tf {x} {792 - y - size} Td ({quoted}) Tj ET")
        stream = "\n".join(drawn)
        kids.append(f"{len(objects) + 1} 0 R")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    body = "".join(f"{i} 0 obj\n{x}\nendobj\n" for i, x in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer << /Root 1 0 R >>\n%%EOF\n".encode("latin-1", "replace")
