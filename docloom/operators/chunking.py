"""Paragraph blocks, flattening, and the two chunkers.

blocks: doc, ord, block_type (heading, paragraph, table), text and further columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import strip, strip_each

SEPARATOR = "\n\n"


def text_blocks(docs: DataFrame, key: str, text: str, separator: str = SEPARATOR) -> DataFrame:
    """Paragraph blocks of plain texts: split at the separator, stripped, empty ones dropped."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    parts = F.filter(strip_each(F.split(plain, separator)), lambda p: p != "")
    return docs.select(F.col(key).alias("doc"), F.posexplode(parts).alias("ord", "text")).select("doc", F.col("ord").cast("long").alias("ord"), F.lit("paragraph").alias("block_type"), "text")


def flatten(blocks: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """blocks with char_start and char_end, half-open, in the text joined by the separator."""
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(separator)).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length("text"))


def flat_text(blocks: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """doc and its blocks' texts in order, joined by the separator."""
    inside = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(inside, lambda b: b["text"]), separator).alias("text"))


def naive_chunks(texts: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Fixed windows over doc, text: doc, chunk_index, char_start, char_end, text; blank windows take no index."""
    step = max(size - overlap, 1)
    n = F.length("text")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    windows = texts.where(strip(F.col("text")) != "").select("doc", "text", F.explode(F.filter(starts, lambda s: s < F.length("text"))).alias("s"))
    cut = windows.select("doc", F.col("s").cast("long").alias("char_start"), F.least(F.col("s") + size, n).cast("long").alias("char_end"), F.col("text").substr(F.col("s") + 1, F.lit(size)).alias("text"))
    cut = cut.where(strip(F.col("text")) != "")
    return cut.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc").orderBy("char_start")) - 1).cast("long"))


def attribute(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """chunks with ord, the block of spans that each overlaps most; of equal overlaps the first."""
    over = F.least("c.char_end", "s.char_end") - F.greatest("c.char_start", "s.char_start")
    pairs = chunks.alias("c").join(spans.alias("s"), (F.col("c.doc") == F.col("s.doc")) & (F.col("s.char_start") <= F.col("c.char_end")) & (F.col("s.char_end") >= F.col("c.char_start")), "left")
    best = F.max_by("s.ord", F.struct(over.alias("o"), (-F.col("s.ord")).alias("first")))
    return pairs.groupBy("c.doc", "c.chunk_index", "c.char_start", "c.char_end").agg(best.alias("ord"))


def structure_chunks(blocks: DataFrame, max_chars: int = 1200, separator: str = SEPARATOR) -> DataFrame:
    """Chunks along structure: a table alone, a heading starts one, paragraphs gather up to max_chars.

    Borders at tables and headings come from a running count; only the paragraphs between two
    borders are folded, one segment at a time.
    """
    in_doc = Window.partitionBy("doc").orderBy("ord")
    kind = F.col("block_type")
    border = (kind != "paragraph") | (F.lag("block_type").over(in_doc) == "table")
    spans = flatten(blocks, separator).withColumn("segment", F.sum(F.when(border, 1).otherwise(0)).over(in_doc))
    row = F.struct("ord", F.length("text").alias("n"), (kind != "heading").alias("content"), (kind == "table").alias("table"), "text", "char_start", "char_end")
    segments = spans.groupBy("doc", "segment").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def groups(rows: pa.Array) -> pa.Array:
        out = []
        for blocks in rows.to_pylist():
            chars, content, group, places = 0, False, 0, []
            for x in blocks:
                if content and chars + x["n"] > max_chars:
                    chars, content, group = 0, False, group + 1
                chars, content = chars + x["n"], content or x["content"]
                places.append(group)
            out.append(places)
        return pa.array(out, pa.list_(pa.int32()))

    sizes = F.transform("rows", lambda r: F.struct(r["n"].alias("n"), r["content"].alias("content")))
    grouped = segments.withColumn("groups", F.arrow_udf(groups, "array<int>")(sizes))
    flat = grouped.select("doc", "segment", F.explode(F.arrays_zip("rows", "groups")).alias("x")).select("doc", "segment", "x.groups", "x.rows.*")
    chunks = flat.groupBy("doc", "segment", "groups").agg(
        F.min("ord").alias("ord"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), separator).alias("text"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.bool_or("content").alias("content"), F.bool_or("table").alias("from_table"),
    ).where("content")
    return chunks.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1).cast("long").alias("chunk_index"), "char_start", "char_end", "from_table", "text")


STRATEGIES = {"naive": "naive_fixed_size", "structure_aware": "structure_aware"}


def chunk_documents(blocks: DataFrame, strategy: str = "structure_aware", separator: str = SEPARATOR) -> DataFrame:
    """Chunks of blocks (with page and section_path): doc, chunk_index, strategy, text, page, section_path, char_start, char_end, from_table.

    A structure-aware chunk has page and path of its first block, a fixed window those of the block it
    overlaps most.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking {strategy!r}; one of {', '.join(STRATEGIES)}")
    spans = flatten(blocks, separator)
    if strategy == "naive":
        chunks = naive_chunks(flat_text(blocks, separator))
        of = attribute(chunks, spans).select("doc", "chunk_index", "ord")
        chunks = chunks.join(of, ["doc", "chunk_index"]).join(spans.select("doc", "ord", "page", "section_path", (F.col("block_type") == "table").alias("from_table")), ["doc", "ord"])
    else:
        chunks = structure_chunks(blocks, separator=separator).join(spans.select("doc", "char_start", "page", "section_path"), ["doc", "char_start"])
    return chunks.select("doc", "chunk_index", F.lit(STRATEGIES[strategy]).alias("strategy"), "text", "page", "section_path", "char_start", "char_end", "from_table")
