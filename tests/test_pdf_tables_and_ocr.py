"""Frames and several ruled tables on a page, and engines that read pages without text."""

import re

from docloom.operators import extraction, layout
from docloom.sources.pdf import ruled_tables, write_pdf
from pyspark.sql import functions as F


def grid(x, y, columns, rows, w=80, h=20):
    across = [(x, y + i * h, x + columns * w, y + i * h) for i in range(rows + 1)]
    return across + [(x + j * w, y, x + j * w, y + rows * h) for j in range(columns + 1)]


def cells(x, y, texts, w=80, h=20):
    return [(10, x + j * w + 4, y + i * h + 4, t) for i, row in enumerate(texts) for j, t in enumerate(row)]


FRAME = grid(20, 20, 1, 1, 570, 750)
FIRST, SECOND = [["a", "b"], ["1", "2"]], [["c", "d", "e"], ["3", "4", "5"], ["6", "7", "8"]]
PAGE = {
    "lines": FRAME + grid(50, 100, 2, 2) + grid(50, 300, 3, 3),
    "texts": [(20, 50, 50, "Heading"), *cells(50, 100, FIRST), (10, 50, 200, "between the two of them"), *cells(50, 300, SECOND), (10, 50, 500, "after them both")],
}


def test_frames_are_no_tables_and_a_page_has_several():
    assert ruled_tables({"rules": FRAME, "spans": []}) == [] and ruled_tables({"rules": [], "spans": []}) == []
    assert [len(t["rows"]) for t in ruled_tables({"rules": PAGE["lines"], "spans": []})] == [2, 3]


def test_tables_of_a_page_keep_what_stands_around_them(spark):
    files = spark.createDataFrame([("a.pdf", write_pdf([PAGE])), ("b.pdf", write_pdf([{"lines": FRAME, "texts": [(20, 50, 50, "Heading"), (10, 50, 200, "a paragraph in a frame")]}]))], "source_path string, content binary")
    read = {r["source_path"]: r["blocks"] for r in extraction.extract(files).collect()}
    kinds = [(b["block_type"], b["table_rows"] or b["text"]) for b in read["a.pdf"]]
    assert kinds == [("heading", "Heading"), ("table", FIRST), ("paragraph", "between the two of them"), ("table", SECOND), ("paragraph", "after them both")]
    assert [(b["block_type"], b["text"]) for b in read["b.pdf"]] == [("heading", "Heading"), ("paragraph", "a paragraph in a frame")]


class Engine:
    """Tells the first bytes of the file; nothing for odd pages."""

    def recognise(self, pages):
        return pages.select("doc", "page", F.when(F.col("page") % 2 == 0, F.concat(F.lit("read from "), F.substring("content", 1, 5).cast("string"))).alias("text"))


def test_an_ocr_engine_gets_the_file_and_its_texts_count(spark):
    full = {"texts": [(10, 50, 50, "a page with enough of text on it")]}
    files = spark.createDataFrame([("a.pdf", write_pdf([full, {}, {}])), ("b.pdf", write_pdf([full])), ("c.txt", b"text")], "source_path string, content binary")
    got = {r["source_path"]: r for r in extraction.extract(files, ocr=Engine()).collect()}
    quality = got["a.pdf"]["quality"]
    assert (quality["pages_needing_ocr"], quality["pages_ocr_recovered"], quality["extraction_failures"]) == (2, 1, ["page_3_ocr_failed: no_text_returned"])
    assert [(b["text"], b["page"], b["from_ocr"]) for b in got["a.pdf"]["blocks"]] == [("a page with enough of text on it", 1, False), ("read from %PDF-", 2, True)]
    assert got["b.pdf"]["quality"]["pages_needing_ocr"] == 0 and got["c.txt"]["blocks"][0]["text"] == "text"


def test_texts_of_pages_are_dealt_out_twice(spark):
    spans = spark.createDataFrame([(1, 1, i, 0, 0, t, 10.0 + i, 40.0, 50.0 * i, 560.0, 50.0 * i + 10) for i, t in enumerate(["Big title", " \x1d ", " x  y\x1e"])], "doc long, page int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([], "doc long, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>")
    pages = spark.createDataFrame([(1, 1, 600.0)], "doc long, page int, width double")
    assert [(r["ord"], r["text"]) for r in layout.pdf_blocks(spans, tables, pages).orderBy("ord").collect()] == [(0, "Big title"), (1, "x y")]
    assert layout.page_medians(spans).collect() == [(1, 1, 11.0)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(layout.pdf_blocks(spans, tables, pages)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    # of spans by page and of items by document; buf: what is gathered of a block's texts
    assert len(dealt) > 4 and len([x for x in dealt if "text#" in x or "block#" in x and "buf#" in x]) == 2, plan
