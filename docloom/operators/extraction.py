"""Files to blocks, by detected type: the router, the flat baseline, and the quality of what came out.

files: source_path, content (null where a file could not be read). Nothing raises for a bad file: it has
no blocks, and its failures say why. Repeated paths are files of their own where their contents
differ. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import layout
from docloom.operators.detection import sniff
from docloom.operators.models import OcrEngine
from docloom.sources import docx, html, pdf

BLOCK = "struct<ord: bigint, block_type: string, text: string, section_path: array<string>, page: int, from_ocr: boolean, table_rows: array<array<string>>, caption: string>"
EXTRACTED = f"source_path string, content_hash string, doc_type string, confidence double, signals array<string>, blocks array<{BLOCK}>, failures array<string>, pages_total int, pages_processed int"
LAYOUT = "pages array<struct<page: int, width: double, spans: array<struct<block: int, line: int, span: int, text: string, size: double, x0: double, y0: double, x1: double, y1: double>>, `tables`: array<struct<x0: double, y0: double, x1: double, y1: double, `rows`: array<array<string>>>>>>"
MODES = ("structure_aware", "naive")
#: Files that leave a task at once, and bytes of them; a larger file leaves alone.
FILES, FILE_BYTES = 256, 1 << 20
_PDF = ("pdf_text", "pdf_scanned")


def _text_blocks(text: str) -> tuple[list[dict], list[str]]:
    parts = [p.strip() for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    found = [html.new_block(i, "paragraph", p, []) for i, p in enumerate(p for p in parts if p)]
    return found, [] if found else ["no_paragraphs_recovered"]


def _flat(kind: str, data: bytes) -> str:
    if kind in _PDF:
        file = pdf.PdfFile(data)
        return "\n".join("\n".join(s[3] for s in file.page(i)["spans"]) for i in range(len(file.pages)))
    if kind == "docx":
        return docx.all_text(data)
    return html.all_text(data.decode("utf-8", "replace")) if kind == "html" else data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _of_file(data: bytes | None, mode: str) -> tuple[str, float, list[str], list[dict], list[str], list[dict]]:
    """Type, confidence, signals, blocks, failures and, for PDF, the pages to lay out."""
    if data is None:
        return "unknown", 0.0, ["read_error"], [], ["read_error"], []
    kind, confidence, signals = sniff(data)
    if kind == "unknown":
        return kind, confidence, signals, [], [f"unsupported_or_undetected_format: confidence={confidence:.2f}, signals={signals}"], []
    try:
        if mode == "naive":
            text = _flat(kind, data).strip()
            return kind, confidence, signals, [html.new_block(0, "paragraph", text, [])] if text else [], [] if text else ["no_content_recovered"], []
        if kind in _PDF:
            file, pages = pdf.PdfFile(data), []
            for i in range(len(file.pages)):
                page = file.page(i)
                pages.append({"page": i + 1, "width": page["width"], "spans": page["spans"], "tables": pdf.ruled_tables(page)})
            return kind, confidence, signals, [], [], pages
        if kind == "plain_text":
            blocks, failures = _text_blocks(data.decode("utf-8", "replace"))
        else:
            blocks, failures = docx.read_docx(data) if kind == "docx" else html.read_html(data.decode("utf-8", "replace"))
            failures += [] if blocks else ["no_content_recovered"]
        return kind, confidence, signals, blocks, failures, []
    except Exception as wrong:  # noqa: BLE001 - one broken file must not end the job
        return kind, confidence, signals, [], [f"{'naive_extract_failed' if mode == 'naive' else 'open_error'}: {wrong}"], []


def _read(files: DataFrame, mode: str) -> DataFrame:
    """EXTRACTED and the laid-out pages of PDF files, one row for each file; written once, as several jobs read it and a file is read by none of them again."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from docloom.operators.store import new_folder

    schema = T.StructType.fromDDL(f"{EXTRACTED}, {LAYOUT}")
    arrow = to_arrow_schema(schema)
    spans = [f.name for f in schema["pages"].dataType.elementType["spans"].dataType.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, data, digest in zip(*(batch.column(c) for c in ("source_path", "content", "content_hash"))):
                path, data, digest = path.as_py(), data.as_py(), digest.as_py()
                kind, confidence, signals, blocks, failures, pages = _of_file(data, mode)
                named = [{**b, "ord": b["order"]} for b in blocks]
                laid = [{**p, "spans": [dict(zip(spans, s)) for s in p["spans"]]} for p in pages]
                total = len(pages) if kind in _PDF and mode != "naive" and not failures else None
                rows.append({"source_path": path, "content_hash": digest, "doc_type": kind, "confidence": confidence, "signals": signals, "blocks": named, "failures": failures, "pages_total": total, "pages_processed": total if total is not None else int(bool(blocks) or kind in ("html", "docx", "plain_text") and not any("error" in f or "failed" in f for f in failures)), "pages": laid})
                size += len(data or b"")
                if len(rows) == FILES or size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    hashed = files.select("source_path", "content", F.sha2("content", 256).alias("content_hash"))
    path = new_folder(files.sparkSession, "extracted")
    hashed.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return files.sparkSession.read.schema(schema).parquet(path)


def extract(files: DataFrame, mode: str = "structure_aware", ocr: OcrEngine | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each file: source_path, content_hash, doc_type, confidence, signals, blocks and quality.

    ocr: an OcrEngine, or a function as its recognise(), from pages to recognise (doc, page, and content, the
    bytes of the page's file) to doc, page, text. Without one, and where text is null, such pages are reported.
    """
    if mode not in MODES:
        raise ValueError(f"unknown extraction {mode!r}; one of {', '.join(MODES)}")
    read = _read(files, mode)
    plain = read.where(~F.col("doc_type").isin(*_PDF) | F.lit(mode == "naive") | (F.size("failures") > 0)).drop("pages")
    quality = plain.withColumn("pages_needing_ocr", F.lit(0)).withColumn("pages_ocr_recovered", F.lit(0))
    return _rated(quality if mode == "naive" else quality.unionByName(_laid_out(read, files, ocr)))


def _laid_out(read: DataFrame, files: DataFrame, ocr) -> DataFrame:
    whole = read.where(F.col("doc_type").isin(*_PDF) & (F.size("failures") == 0)).withColumn("doc", F.struct("source_path", "content_hash"))
    each = whole.select("doc", F.explode("pages").alias("p"))
    pages = each.select("doc", "p.page", "p.width")
    spans = each.select("doc", "p.page", F.explode("p.spans").alias("s")).select("doc", "page", "s.*")
    tables = each.select("doc", "p.page", F.explode("p.tables").alias("t")).select("doc", "page", "t.*")
    need = layout.pages_to_recognise(layout.page_items(spans, tables), pages)
    found, missing = None, "tesseract_not_installed"
    if ocr:
        sources = files.select(F.struct("source_path", F.sha2("content", 256).alias("content_hash")).alias("doc"), "content")
        found = getattr(ocr, "recognise", ocr)(need.join(sources, "doc")).select("doc", "page", "text").dropDuplicates(["doc", "page"])
        missing = "no_text_returned"
    seen = need.join(found, ["doc", "page"], "left") if ocr else need.withColumn("text", F.lit(None).cast("string"))
    told = F.when(F.col("text") == "", F.format_string("page_%d_no_text_and_ocr_empty", "page")).when(F.col("text").isNull(), F.format_string(f"page_%d_ocr_failed: {missing}", "page"))
    report = seen.groupBy("doc").agg(F.count("*").cast("int").alias("pages_needing_ocr"), F.count_if(F.col("text") != "").cast("int").alias("pages_ocr_recovered"), F.transform(F.sort_array(F.collect_list(F.when(told.isNotNull(), F.struct("page", told.alias("f"))))), lambda x: x["f"]).alias("told"))
    made = layout.pdf_blocks(spans, tables, pages, found)
    blocks = made.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "block_type", "text", "section_path", F.col("page").cast("int").alias("page"), "from_ocr", "table_rows", "caption"))).alias("made"))
    joined = whole.drop("pages", "blocks", "failures").join(blocks, "doc", "left").join(report, "doc", "left")
    nothing = F.when(F.col("made").isNull(), F.array(F.lit("no_content_recovered_from_any_page"))).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "source_path", "content_hash", "doc_type", "confidence", "signals", F.coalesce("made", F.array().cast(f"array<{BLOCK}>")).cast(f"array<{BLOCK}>").alias("blocks"),
        F.concat(F.coalesce("told", F.array().cast("array<string>")), nothing).alias("failures"), "pages_total", "pages_processed",
        F.coalesce("pages_needing_ocr", F.lit(0)).alias("pages_needing_ocr"), F.coalesce("pages_ocr_recovered", F.lit(0)).alias("pages_ocr_recovered"),
    )


def _rated(rows: DataFrame) -> DataFrame:
    tables = F.size(F.filter("blocks", lambda b: b["block_type"] == "table"))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"]))
    quality = F.struct("pages_total", "pages_processed", "pages_needing_ocr", "pages_ocr_recovered", tables.alias("tables_found"), chars.alias("chars_recovered"), F.col("failures").alias("extraction_failures"))
    return rows.select("source_path", "content_hash", "doc_type", "confidence", "signals", "blocks", quality.alias("quality"))


def blocks_of(extracted: DataFrame) -> DataFrame:
    """A row for each block: doc (the path) and the block's fields."""
    return extracted.select(F.col("source_path").alias("doc"), F.explode("blocks").alias("b")).select("doc", "b.*")
