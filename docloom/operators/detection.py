"""Document types from content.

detect() is a column expression for what marks and characters tell; sniff() also looks into PDF and ZIP
files and gives its reasons. Both decode by the same ladder and so agree on all other files. Null and empty content is unknown.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 4096
#: Marks of HTML, strong ones within the first 512 characters.
STRONG = ("<!doctype html", "<html")
#: Also fixed: the marks of PDF and ZIP, the pages of a PDF looked at, the characters a page with text has, and the confidences below.
PDF_MARK, ZIP_MARKS = b"%PDF-", (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
PDF_PAGES, PAGE_CHARS = 5, 20
WEAK = ("<head", "<body", "<title", "<div", "<meta", "<script", "<p>", "<a href")


#: A half of a surrogate pair without its other half, among hexadecimal units that end in a space.
_LONE = r"\b{high}(?!{low})|(?<!\b{high})\b{low}"


def _header(content: Column) -> Column:
    """The first bytes as text, by the ladder of decoded()."""
    head = F.substring(content, 1, HEADER_BYTES)
    cuts = [F.substring(content, 1, HEADER_BYTES - cut) for cut in range(4)]
    whole = [F.when((F.length(head) >= HEADER_BYTES) if cut else F.lit(True), F.when(F.is_valid_utf8(x.cast("string")), x.cast("string"))) for cut, x in enumerate(cuts)]
    big = F.hex(F.substring(head, 1, 2)) == "FEFF"
    body = F.when(big | (F.hex(F.substring(head, 1, 2)) == "FFFE"), F.substring(head, 3, HEADER_BYTES)).otherwise(head)
    units = F.regexp_replace(F.hex(body), "(....)", "$1 ")
    lone = units.rlike(_LONE.format(high="..D[89AB] ", low="..D[C-F] "))
    lone_big = units.rlike(_LONE.format(high="D[89AB].. ", low="D[C-F].. "))
    even = F.length(head) % 2 == 0
    return F.coalesce(*whole, F.when(even & big & ~lone_big, F.decode(body, "UTF-16BE")), F.when(even & ~big & ~lone, F.decode(body, "UTF-16LE")), F.decode(head, "ISO-8859-1"))


def detect(content: Column) -> Column:
    """struct<doc_type, confidence> of bytes, by PDF and ZIP marks, HTML marks and the share of printable characters."""
    return F.get(F.transform(F.array(_header(content)), lambda raw: _told(content, raw)), 0)  # a lambda's variable is made once


def _told(content: Column, raw: Column) -> Column:
    """detect() of content whose header as text is raw."""
    text = F.regexp_replace(F.lower(raw), "^[\ufeff \t\r\n]+", "")
    strong = F.lit(False)
    for s in STRONG:
        strong = strong | (F.instr(F.substring(text, 1, 512), s) > 0)
    weak = sum((F.when(F.instr(text, s) > 0, 1).otherwise(0) for s in WEAK), F.lit(0))
    ratio = F.length(F.regexp_replace(raw, r"[\p{C}\p{Z}&&[^\n\r\t ]]", "")) / F.length(raw)
    latin = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    made = lambda kind, confidence: F.struct(F.lit(kind).alias("doc_type"), confidence.cast("double").alias("confidence"))
    return (
        F.when(content.isNull() | (F.length(content) == 0), made("unknown", F.lit(0.0)))
        .when(F.instr(F.substring(latin, 1, 1024), "%PDF-") > 0, made("pdf", F.lit(0.7)))
        .when(F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708"), made("zip", F.lit(0.4)))
        .when(strong, made("html", F.least(F.lit(0.75) + 0.05 * F.least(weak, F.lit(5)), F.lit(0.99))))
        .when(F.contains(latin, F.lit("\0")), made("unknown", F.lit(0.2)))
        .when(ratio >= 0.95, made("plain_text", F.least(F.lit(0.6) + 0.3 * ratio, F.lit(0.99))))
        .otherwise(made("unknown", F.lit(0.2)))
    )


def decoded(data: bytes) -> str:
    """data as UTF-8, where a character cut at the end is left off, else as UTF-16, else as Latin-1."""
    for cut in range(4):
        try:
            return data[: len(data) - cut].decode("utf-8")
        except UnicodeDecodeError as wrong:
            if wrong.end < len(data) - cut or len(data) < HEADER_BYTES:
                break
    try:
        return data.decode("utf-16")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _of_pdf(data: bytes) -> tuple[str, float, list[str]]:
    from docloom.sources.pdf import PdfFile

    said = ["pdf_header_present"]
    try:
        file = PdfFile(data)
        looked = min(PDF_PAGES, len(file.pages))
        if not looked:
            return "unknown", 0.3, [*said, "pdf_has_zero_pages"]
        full = sum(len(" ".join(s[3] for s in file.page(i)["spans"]).strip()) >= PAGE_CHARS for i in range(looked))
    except Exception as wrong:  # noqa: BLE001 - a broken file is told of, not raised
        return "unknown", 0.3, [*said, f"pdf_read_failed: {wrong}"]
    said += [f"sampled_{looked}_of_{len(file.pages)}_pages", f"pages_with_text={full}"]
    return ("pdf_text", min(0.7 + 0.3 * full / looked, 0.99), said) if full else ("pdf_scanned", 0.85, said)


def _of_zip(data: bytes) -> tuple[str, float, list[str]]:
    said = ["zip_header_present"]
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, OSError, ValueError) as wrong:
        return "unknown", 0.2, [*said, f"bad_zip: {wrong}"]
    if "word/document.xml" in names:
        return "docx", 0.95, [*said, "found_word/document.xml"]
    return "unknown", 0.4, [*said, f"zip_but_not_docx: {names[:5]}"]


def sniff(data: bytes) -> tuple[str, float, list[str]]:
    """Type, confidence and signals of a file's bytes; never raises."""
    head = data[:HEADER_BYTES]
    if not data:
        return "unknown", 0.0, ["empty_file"]
    if PDF_MARK in head[:1024]:
        return _of_pdf(data)
    if head.startswith(ZIP_MARKS):
        return _of_zip(data)
    text = decoded(head)
    low = text.lower().lstrip("\ufeff \t\r\n")
    marks = [s for s in STRONG if s in low[:512]]
    if marks:
        weak = sum(s in low for s in WEAK)
        return "html", min(0.75 + 0.05 * min(weak, 5), 0.99), [f"matched:{','.join(marks)}", f"weak_signals={weak}"]
    if b"\0" in head:
        return "unknown", 0.2, ["null_byte_in_header"]
    share = sum(c.isprintable() or c in "\n\r\t" for c in text) / max(1, len(text))
    return ("plain_text", min(0.6 + 0.3 * share, 0.99), [f"printable_ratio={share:.2f}"]) if share >= 0.95 else ("unknown", 0.2, [f"printable_ratio={share:.2f}"])
