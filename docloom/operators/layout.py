"""Blocks of PDF pages from tables of their text spans, ruled tables and page sizes.

spans: doc, page, block, line, span, text, size, x0, y0, x1, y1; tables: doc, page, x0, y0, x1, y1,
rows; pages: doc, page, width. Everything is joins and windows by document and page: texts are dealt
out once by page, where medians, tables and widths meet them, and once by document for what is ordered.

Defined results: spans without text count for nothing. Ties in place keep the order of blocks, text
before tables. Empty inputs give empty results. doc and page are never null; of several widths of a
page the greatest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import is_caption, strip

#: A size without spans; a heading's size against the median and most words; the share of a block in a table; the band of a gutter; the characters of a page that needs no OCR.
NO_SIZE, HEADING_RATIO, HEADING_WORDS, TABLE_SHARE, GUTTER, OCR_CHARS = 10.0, 1.15, 15, 0.5, (0.35, 0.65), 20


def _full() -> Column:
    """The size of a span with text."""
    return F.when(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.col("size"))


def median_sizes(spans: DataFrame, *more: Column) -> DataFrame:
    """doc and the median size of its spans with text; NO_SIZE without any. more: further aggregates."""
    return spans.groupBy("doc").agg(F.coalesce(F.median(_full()), F.lit(NO_SIZE)).alias("median_size"), *more)


def page_medians(spans: DataFrame) -> DataFrame:
    """median_sizes for each page of the document, so that blocks meet them where their page is."""
    return median_sizes(spans, F.collect_set("page").alias("pages")).select("doc", F.explode("pages").alias("page"), "median_size")


def text_blocks(spans: DataFrame) -> DataFrame:
    """A row for each block with text: its text with white space collapsed, its largest size and its box."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("line", "span", "text"))), lambda s: s["text"])
    text = F.trim(F.regexp_replace(F.array_join(pieces, " "), r"(?U)[\s\x1c-\x1f]+", " "))
    size = F.max(_full())
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return spans.repartition("doc", "page").groupBy("doc", "page", "block").agg(text.alias("text"), F.coalesce(size, F.lit(0.0)).alias("size"), *box).where("text <> ''")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks without those that a table of their page covers by half or more."""
    wide = F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0")
    tall = F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    covered = (F.col("b.doc") == F.col("t.doc")) & (F.col("b.page") == F.col("t.page")) & (wide > 0) & (tall > 0) & (wide * tall >= TABLE_SHARE * area)
    return blocks.alias("b").join(tables.alias("t"), covered, "left_anti")


def with_headings(blocks: DataFrame, medians: DataFrame) -> DataFrame:
    """blocks with is_heading: large, short and without a sentence's end. medians: of median_sizes or page_medians."""
    words = F.size(F.split("text", " "))
    heading = (F.col("size") >= F.col("median_size") * HEADING_RATIO) & (words <= HEADING_WORDS) & ~F.col("text").rlike("[.,;]$")
    return blocks.join(medians, [c for c in ("doc", "page") if c in medians.columns]).withColumn("is_heading", heading).drop("median_size")


def _middle(each=lambda c: c) -> Column:
    """The middle between two columns, of a page's boxes and width; each: where they are aggregated."""
    low, high = (F.col("width") * x for x in GUTTER)
    clear = ~each(F.bool_or((F.col("x0") < high) & (F.col("x1") > low)))
    both = each(F.bool_or(F.col("x1") <= low)) & each(F.bool_or(F.col("x0") >= high))
    return F.when(clear & both & (F.col("width") > 0), (low + high) / 2)


def gutters(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page and the middle between two columns; null where an item reaches into the band or a side is empty."""
    return items.join(pages, ["doc", "page"]).groupBy("doc", "page", "width").agg(_middle().alias("gutter")).drop("width")


def reading_order(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with place: by column where the page has a gutter, then from top to bottom and left to right."""
    return in_order(with_widths(items, pages))


def with_widths(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items with the width of their page, which is null where pages lack it."""
    return items.join(pages.groupBy("doc", "page").agg(F.max("width").alias("width")), ["doc", "page"], "left")


def in_order(items: DataFrame) -> DataFrame:
    """reading_order of items with the width of their page."""
    page = Window.partitionBy("doc", "page")
    placed = items.withColumn("gutter", _middle(lambda c: c.over(page)))
    column = F.when(F.col("gutter").isNull() | ((F.col("x0") + F.col("x1")) / 2 < F.col("gutter")), 0).otherwise(1)
    order = Window.partitionBy("doc", "page").orderBy("side", "y0", "x0", "kind", "seq")
    return placed.withColumn("side", column).withColumn("place", F.row_number().over(order).cast("long")).drop("side", "gutter", "width")


def table_rows(rows: Column) -> Column:
    """rows with cells stripped and nulls as empty texts, without those that are blank."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def pages_to_recognise(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc and page of pages with fewer than OCR_CHARS characters outside tables."""
    chars = items.groupBy("doc", "page").agg(F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("chars"))
    return pages.join(chars, ["doc", "page"], "left").where(F.coalesce("chars", F.lit(0)) < OCR_CHARS).select("doc", "page")


def page_items(spans: DataFrame, tables: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Texts outside of tables, and tables: doc, page, kind, seq, text, is_heading, table_rows and box, and with pages their width."""
    texts = with_headings(outside_tables(text_blocks(spans), tables), page_medians(spans))
    box = ["x0", "y0", "x1", "y1"]
    texts = texts.select("doc", "page", F.lit("text").alias("kind"), F.col("block").cast("long").alias("seq"), "text", "is_heading", F.lit(None).cast("array<array<string>>").alias("table_rows"), *box)
    ruled = tables.select("doc", "page", F.lit("table").alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_heading"), table_rows(F.col("rows")).alias("table_rows"), *box)
    if pages is not None:
        texts, ruled = with_widths(texts, pages), with_widths(ruled, pages)
    return texts.unionByName(ruled)


def pdf_blocks(spans: DataFrame, tables: DataFrame, pages: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """Blocks in reading order: doc, ord, block_type, text, section_path, page, from_ocr, table_rows, caption.

    recognised: doc, page and text of pages read by OCR; such a text comes before its page's own items.
    A table takes a caption-like paragraph right before it along, which leaves a gap in the order.
    """
    items = in_order(page_items(spans, tables, pages).repartition("doc")).withColumn("from_ocr", F.lit(False))
    if recognised is not None:
        none = {c: F.lit(None).cast(items.schema[c].dataType) for c in ("table_rows", "x0", "y0", "x1", "y1")}
        ocr = recognised.where("text <> ''").select("doc", "page", F.lit("text").alias("kind"), F.lit(0).cast("long").alias("seq"), "text", F.lit(False).alias("is_heading"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("from_ocr"), *[v.alias(c) for c, v in none.items()])
        items = items.unionByName(ocr)
    items = items.where((F.col("kind") == "text") | (F.size("table_rows") > 0))
    order = Window.partitionBy("doc").orderBy("page", "place")
    kind = F.when(F.col("kind") == "table", "table").when(F.col("is_heading"), "heading").otherwise("paragraph")
    drawn = F.array_join(F.transform("table_rows", lambda r: F.array_join(r, " | ")), "\n")
    rows = items.select("doc", "page", "place", kind.alias("block_type"), F.coalesce("text", drawn).alias("text"), "from_ocr", "table_rows", (F.row_number().over(order) - 1).cast("long").alias("ord"))
    in_doc = Window.partitionBy("doc").orderBy("ord")
    heading = F.last(F.when(F.col("block_type") == "heading", F.col("text")), True).over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    caption = (F.col("block_type") == "paragraph") & is_caption(F.col("text"))
    taken = caption & (F.lead("block_type").over(in_doc) == "table")
    before = F.when(F.lag(caption).over(in_doc), F.lag("text").over(in_doc))
    rows = rows.withColumn("section_path", F.when(heading.isNull(), F.array().cast("array<string>")).otherwise(F.array(heading)))
    rows = rows.withColumn("caption", F.when(F.col("block_type") == "table", before)).withColumn("taken", F.coalesce(taken, F.lit(False)))
    return rows.where("NOT taken").select("doc", "ord", "block_type", "text", "section_path", "page", "from_ocr", "table_rows", "caption")
