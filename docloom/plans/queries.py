"""Queries over the test tables for the retrieval engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as fx
from docloom.operators import answering, chunking, detection, evaluation, extraction, layout, retrieval, store, threads
from docloom.sources.html import html_blocks


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The vectors that are searched for, among all.
SEARCHED = "vec_id % 20 = 0"


def _vectors(spark, d):
    e = _t(spark, d, "embeddings")
    return e.where(SEARCHED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), e.select(F.col("vec_id").alias("chunk_id"), "embedding")


def dense_topk(spark, d):
    return retrieval.dense(*_vectors(spark, d), 10)


def _vector_index(spark, d):
    """The vectors in an index, taken in in two parts."""
    from docloom.operators.vectors import VectorIndex

    made = VectorIndex(spark, store.new_folder(spark, "vectors"))
    chunks = _vectors(spark, d)[1]
    made.fit(chunks)
    for part in (0, 1):
        made.add(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part))
    return made


def vector_index_topk(spark, d):
    """What dense_topk finds, by the bounds of an index."""
    return _vector_index(spark, d).search(_vectors(spark, d)[0], 10)


#: Lists that are read for each query where some hits may be missed.
PROBES = 40


def vector_probe_recall(spark, d):
    """For each query its number of exact hits, and how many of them the nearest lists alone find."""
    from docloom.operators.vectors import recall

    made, asked = _vector_index(spark, d), _vectors(spark, d)[0]
    return recall(made.search(asked, 10, PROBES), retrieval.dense(asked, _vectors(spark, d)[1], 10))


def _words_queries(spark, d):
    items = _t(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def lexical_simple_topk(spark, d):
    return retrieval.lexical(_words_queries(spark, d), _chunks(spark, d), 10)


def indexed_topk(spark, d):
    """The documents taken into an index in two parts, and searched by its blocks."""
    from docloom.operators.index import InvertedIndex

    made = InvertedIndex(spark, store.new_folder(spark, "index"))
    chunks = _chunks(spark, d)
    for part in (0, 1):
        made.add(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part))
    return made.search(_words_queries(spark, d), 10)


def _by_text(spark, d):
    """For each vector that is searched for the whole text of the document of its id."""
    return _t(spark, d, "embeddings").where(SEARCHED).join(_t(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("query_id"), F.col("text").alias("query"))


def hybrid_rrf(spark, d):
    """Dense hits of a vector, fused with the lexical hits of the whole text of the document of its id."""
    return retrieval.hybrid(retrieval.dense(*_vectors(spark, d), 40), retrieval.lexical(_by_text(spark, d), _chunks(spark, d), 40), 10)


def english_topk(spark, d):
    return retrieval.english(_words_queries(spark, d), _chunks(spark, d), 10)


def retrieved_payload(spark, d):
    """The best vectors with the document of their id, joined after the best are known."""
    owners = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("source_document"), "text")
    return retrieval.with_payload(retrieval.dense(*_vectors(spark, d), 10), owners)


def rerank_topk(spark, d):
    q, c = _words_queries(spark, d), _chunks(spark, d)
    return retrieval.rerank(retrieval.lexical(q, c, 15), q, c, 5)


def _turns(spark, d):
    return _t(spark, d, "conversations")


def _answers(spark, d):
    """Every assistant turn, named by its conversation and turn."""
    return _turns(spark, d).where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))


def _passages(spark, d):
    return _turns(spark, d).where("role = 'user'").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("long").alias("rank"), F.lit("talk").alias("source"), "text")


def _passages_before(spark, d):
    """For every assistant turn the user turns before it."""
    said = _passages(spark, d).withColumnRenamed("query_id", "conv_id")
    return _turns(spark, d).where("role = 'assistant'").select("conv_id", "turn").join(said, "conv_id").where("rank <= turn").select(F.struct("conv_id", "turn").alias("query_id"), "rank", "source", "text")


def _by_turn(df):
    return df.select(F.col("query_id.conv_id").alias("query_id"), F.col("query_id.turn").alias("turn"), *[c for c in df.columns if c != "query_id"])


def sentences(spark, d):
    return _by_turn(answering.sentences(_answers(spark, d)))


def word_overlap(spark, d):
    pairs = _answers(spark, d).join(_passages_before(spark, d), "query_id")
    return _by_turn(pairs.select("query_id", "rank", F.round(fx.overlap_score(F.col("answer"), F.col("text")), 6).alias("score")))


def ground_sentences(spark, d):
    said = _by_turn(answering.sentences(_answers(spark, d))).withColumnRenamed("query_id", "thread")
    return threads.ground_in_thread(said, _passages(spark, d).withColumnRenamed("query_id", "thread")).withColumnRenamed("thread", "query_id")


def prompt(spark, d):
    questions = _turns(spark, d).groupBy("conv_id").agg(F.min_by("text", "turn").alias("query")).select(F.col("conv_id").alias("query_id"), "query")
    return answering.prompts(questions, _passages(spark, d))


def _blocks(spark, d):
    return chunking.text_blocks(_t(spark, d, "documents"), "doc_id", "text", "\n")


def flatten_spans(spark, d):
    return chunking.flatten(_blocks(spark, d), "\n").select("doc", "ord", "char_start", "char_end")


def naive_chunks(spark, d):
    return chunking.naive_chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


def naive_chunk_attribution(spark, d):
    blocks = _blocks(spark, d)
    return chunking.attribute(chunking.naive_chunks(chunking.flat_text(blocks, "\n")), chunking.flatten(blocks, "\n"))


def structure_chunks(spark, d):
    """Every ninth line counts as a heading and every eleventh as a table."""
    kind = F.when(F.col("ord") % 9 == 0, "heading").when(F.col("ord") % 11 == 0, "table").otherwise("paragraph")
    return chunking.structure_chunks(_blocks(spark, d).withColumn("block_type", kind), 1200, "\n").select("doc", "chunk_index", "char_start", "char_end", "from_table", F.sha2("text", 256).alias("text_sha256"))


def _paths(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.format_string("doc-%d", "doc_id").alias("source_path"), store.content_hash(F.col("text")).alias("content_hash"))


def _stored(spark, d):
    """The state before: documents with labels, of another hash where the quality is 0."""
    labels = _t(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return _paths(spark, d).join(labels, "doc_id").withColumn("content_hash", F.when(F.col("quality") == 0, "old").otherwise(F.col("content_hash")))


def content_hash_diff(spark, d):
    return store.changes(_paths(spark, d).select("source_path", "content_hash"), _stored(spark, d).select("source_path", "content_hash"))


def upsert_documents(spark, d):
    stored = _stored(spark, d).select((F.col("doc_id") + 1).alias("id"), "source_path", "content_hash")
    return store.upsert(stored, _paths(spark, d).select("source_path", "content_hash"))


def _two_tables(spark, d):
    """Documents by path, and their lines as chunks."""
    documents = _t(spark, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.format_string("doc-%d", "doc_id").alias("source_path"), "lang")
    chunks = _blocks(spark, d).select((F.col("doc") + 1).alias("document_id"), F.col("ord").alias("chunk_index"), "text")
    gone = _t(spark, d, "labels").where("quality = 0").select(F.format_string("doc-%d", "doc_id").alias("source_path"))
    return documents, chunks, gone


def cascade_delete(spark, d):
    """What is left of both tables: each document with the number of its chunks, and chunks without document."""
    documents, chunks = store.cascade(*_two_tables(spark, d))
    left = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    return documents.join(left, "id", "full").select("id", "source_path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def replace_chunks(spark, d):
    """Documents of quality 0 get one chunk of their language; others keep theirs."""
    documents, chunks, changed = _two_tables(spark, d)
    new = documents.join(changed.distinct(), "source_path").select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.coalesce("lang", F.lit("")).alias("text"))
    return store.replace_chunks(chunks, new).select("document_id", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


def bucketed_chunks(spark, d):
    """Each document and its lines go into bucketed tables; those of quality 0 come again with their language as the one chunk, and are compacted."""
    documents, chunks, changed = _two_tables(spark, d)
    library = store.Library(spark, store.new_folder(spark, "bucketed"))
    again = documents.join(changed.distinct(), "source_path", "left_semi")
    for version, (owners, lines) in enumerate(((documents, chunks), (again, again.select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.coalesce("lang", F.lit("")).alias("text")))), 1):
        library.put(lines, owners.select("id", "source_path"), version)
    library.compact()
    return library.chunks().select("document_id", "source_document", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


def chunk_count(spark, d):
    return _blocks(spark, d).agg(F.count("*").alias("n"))


def _laid_out(spark, d):
    """Lines of documents as spans of pages of twelve, in one column or two; on odd pages a table covers the fourth line."""
    page, at = F.floor(F.col("ord") / 12) + 1, F.col("ord") % 12
    two = (F.col("doc") + page) % 2 == 0
    x0 = F.when(two & (F.col("ord") % 2 == 1), 420.0).otherwise(40.0)
    spans = _blocks(spark, d).select(
        "doc", page.cast("int").alias("page"), at.cast("int").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "text", F.when(F.col("ord") % 5 == 0, 14.0).otherwise(10.0).alias("size"),
        x0.alias("x0"), (40 + 50 * at).cast("double").alias("y0"), F.when(two, x0 + 150).otherwise(F.lit(560.0)).alias("x1"), (50 + 50 * at).cast("double").alias("y1"),
    )
    pages = spans.select("doc", "page", F.lit(600.0).alias("width")).distinct()
    tables = pages.where("page % 2 = 1").select("doc", "page", F.lit(0.0).alias("x0"), F.lit(185.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(205.0).alias("y1"), F.array(F.array(F.lit("k "), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit(""))).alias("rows"))
    return spans, tables, pages


def pdf_median_size(spark, d):
    return layout.median_sizes(_laid_out(spark, d)[0])


def pdf_text_items(spark, d):
    spans = _laid_out(spark, d)[0]
    return layout.with_headings(layout.text_blocks(spans), layout.page_medians(spans)).select("doc", "page", "block", F.sha2("text", 256).alias("text_sha256"), "is_heading")


def pdf_outside_tables(spark, d):
    spans, tables, _ = _laid_out(spark, d)
    return layout.outside_tables(layout.text_blocks(spans), tables).select("doc", "page", "block")


def pdf_gutters(spark, d):
    spans, _, pages = _laid_out(spark, d)
    return layout.gutters(layout.text_blocks(spans), pages)


def pdf_reading_order(spark, d):
    spans, tables, pages = _laid_out(spark, d)
    return layout.reading_order(layout.page_items(spans, tables), pages).select("doc", "page", "kind", "seq", "place")


def pdf_pages_to_recognise(spark, d):
    spans, tables, pages = _laid_out(spark, d)
    return layout.pages_to_recognise(layout.page_items(spans, tables), pages)


def pdf_block_rows(spark, d):
    rows = layout.pdf_blocks(*_laid_out(spark, d))
    return rows.select("doc", "ord", "page", "block_type", F.sha2("text", 256).alias("text_sha256"), F.array_join("section_path", "/").alias("section"), F.sha2("caption", 256).alias("caption_sha256"))


#: What XML cannot hold.
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\ufffe\uffff]"


def docx_block_rows(spark, d):
    """Documents written as DOCX, their first line as a heading and a table after every fourth document, and read back."""
    import pyarrow as pa

    from docloom.sources.docx import write_docx

    def made(keys, lines):
        out = []
        for key, texts in zip(keys.to_pylist(), lines.to_pylist()):
            out.append(write_docx([*[(1, t) if i == 0 else t for i, t in enumerate(texts)], *([[["id", str(key)], ["", "x"]]] if key % 4 == 0 else [])]))
        return pa.array(out, pa.binary())

    lines = _blocks(spark, d).withColumn("text", F.regexp_replace("text", _CONTROL, "")).groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("lines"))
    found = extraction.extract(lines.select(F.col("doc").cast("string").alias("source_path"), F.arrow_udf(made, "binary")("doc", "lines").alias("content")))
    return extraction.blocks_of(found).select(F.col("doc").cast("long").alias("doc"), "ord", "block_type", F.sha2("text", 256).alias("text_sha256"), F.sha2(F.array_join("section_path", "/"), 256).alias("section_sha256"), F.sha2("caption", 256).alias("caption_sha256"))


def naive_extraction(spark, d):
    """Each document as a file, taken as one flat text."""
    files = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    found = extraction.extract(files, "naive")
    return found.select(F.col("source_path").cast("long").alias("doc_id"), "doc_type", F.size("blocks").cast("long").alias("n_blocks"), "quality.chars_recovered", F.size("quality.extraction_failures").cast("long").alias("n_failures"))


def html_detect(spark, d):
    got = detection.detect(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return _t(spark, d, "pages").select("page_id", got.alias("x")).select("page_id", "x.doc_type", F.round("x.confidence", 6).alias("confidence"))


def text_detect(spark, d):
    got = detection.detect(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return _t(spark, d, "documents").select("doc_id", got.alias("x")).select("doc_id", "x.doc_type", F.round("x.confidence", 3).alias("confidence"))


def html_block_rows(spark, d):
    return html_blocks(_t(spark, d, "pages"), "page_id", "html")


def caption_flags(spark, d):
    tagged = _blocks(spark, d).withColumn("text", F.when(F.col("doc") % 5 == 0, F.concat(F.lit("Table "), F.col("doc").cast("string"), F.lit(": "), F.col("text"))).otherwise(F.col("text")))
    return tagged.select("doc", "ord", fx.is_caption(F.col("text")).alias("is_caption"), F.lead("ord").over(Window.partitionBy("doc").orderBy("ord")).alias("next_ord"))


def hit_and_mrr(spark, d):
    e = _t(spark, d, "embeddings")
    found = retrieval.dense(*_vectors(spark, d), 10).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("source")), "chunk_id").where("chunk_id <> query_id")
    expected = e.where(SEARCHED).select(F.col("vec_id").alias("query_id"), F.array(F.col("label").cast("string")).alias("expected"))
    scored = evaluation.retrieval_metrics(expected, found.select("query_id", "rank", "source"))
    return scored.select("query_id", "hit", F.round("rr", 6).alias("rr"))


def nearest_rank_percentile(spark, d):
    return evaluation.nearest_rank(_t(spark, d, "events"), ["event_type"], "value", 95)


def quality_rollup(spark, d):
    """Of documents laid out as pages: characters, blocks and tables."""
    rows = layout.pdf_blocks(*_laid_out(spark, d))
    return rows.groupBy("doc").agg(F.sum(F.length("text")).cast("long").alias("chars_recovered"), F.count("*").alias("n_blocks"), F.count_if(F.col("block_type") == "table").alias("tables_found"))


def doc_counts(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


def doc_list(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars")).orderBy("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        english_topk, retrieved_payload, replace_chunks, bucketed_chunks, chunk_count, pdf_median_size, pdf_text_items, pdf_outside_tables, pdf_gutters, pdf_reading_order, pdf_pages_to_recognise, pdf_block_rows,
        docx_block_rows, naive_extraction, dense_topk, lexical_simple_topk, hybrid_rrf, rerank_topk, sentences, word_overlap, ground_sentences, prompt, flatten_spans, naive_chunks, naive_chunk_attribution, structure_chunks,
        indexed_topk, vector_index_topk, vector_probe_recall, content_hash_diff, upsert_documents, cascade_delete, html_detect, text_detect, html_block_rows, caption_flags, hit_and_mrr, nearest_rank_percentile, quality_rollup, doc_counts, doc_list,
    )
}

_DENSE = """p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p)"""
_TERMS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_ANY_LEXICAL = f"""q AS (SELECT item_id AS query_id, list_distinct({_TERMS.format('text')}) AS t, text AS query FROM {{asked}}),
w AS (SELECT query_id, len(t) AS need, unnest(t) AS lexeme FROM q),
post AS (SELECT doc_id AS chunk_id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS lexeme FROM documents) GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, round(0.1::DOUBLE * sum(tf), 6) AS score FROM post JOIN w USING (lexeme) GROUP BY query_id, chunk_id, need HAVING count(*) = need),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits)"""
_LEXICAL = _ANY_LEXICAL.format(asked="benchmark")
_LEXICAL_BY_TEXT = _ANY_LEXICAL.format(asked="(SELECT vec_id AS item_id, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0)")
_ANSWERS = """a AS (SELECT conv_id AS query_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id AS query_id, turn + 1 AS rank, text FROM conversations WHERE role = 'user')"""
_SENTENCES = r"""x AS (SELECT query_id, turn, list_filter(string_split(regexp_replace(trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: s <> '') AS l FROM a),
s AS (SELECT query_id, turn, unnest(range(len(l))) AS i, unnest(l) AS sentence FROM x)"""


def _overlap(a: str, b: str) -> str:
    wa, wb = f"list_distinct({_TERMS.format(a)})", f"list_distinct({_TERMS.format(b)})"
    return f"round(CASE WHEN len({wa}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({wa}, {wb}))::DOUBLE / len({wa}) END, 6)"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BLOCKS = f"""l AS (SELECT doc_id AS doc, [x for x in [trim(y, {_SPACE}) for y in string_split(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10))] if x <> ''] AS l FROM documents),
b AS (SELECT doc, unnest(range(len(l))) AS ord, unnest(l) AS text FROM l),
f AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM b)"""
_WINDOWS = "SELECT doc, text, s AS char_start, least(s + 1000, length(text)) AS char_end, substr(text, s + 1, 1000) AS part FROM (SELECT doc, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900.0)::BIGINT * 900 + 1 END, 900)) AS s FROM {})"

_STORED = """p AS (SELECT doc_id, 'doc-' || doc_id AS source_path, sha256(text) AS h FROM documents),
s AS (SELECT p.doc_id + 1 AS id, source_path, CASE WHEN min(quality) = 0 THEN 'old' ELSE h END AS h FROM p JOIN labels USING (doc_id) GROUP BY p.doc_id, source_path, h)"""
_LAID_OUT = r"""sp AS (SELECT *, x0 + CASE WHEN two THEN 150 ELSE 520 END AS x1, y0 + 10 AS y1 FROM (SELECT doc, ord, (ord // 12 + 1)::INT AS page, (ord % 12)::INT AS block, (doc + ord // 12 + 1) % 2 = 0 AS two,
  trim(regexp_replace(text, '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) AS text, CASE WHEN ord % 5 = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, CASE WHEN two AND ord % 2 = 1 THEN 420 ELSE 40 END AS x0, 40 + 50 * (ord % 12) AS y0 FROM b)),
md AS (SELECT doc, median(size) AS m FROM sp GROUP BY doc),
th AS (SELECT sp.*, size >= m * 1.15 AND len(string_split(text, ' ')) <= 15 AND NOT regexp_matches(text, '[.,;]$') AS is_heading, page % 2 = 1 AND block = 3 AS inside FROM sp JOIN md USING (doc)),
it AS (SELECT doc, page, 'text' AS kind, block::BIGINT AS seq, text, is_heading, x0, x1, y0 FROM th WHERE NOT inside
  UNION ALL SELECT DISTINCT doc, page, 'table', 0, 'k | ', false, 0, 600, 185 FROM sp WHERE page % 2 = 1),
gu AS (SELECT doc, page, CASE WHEN NOT bool_or(x0 < 390 AND x1 > 210) AND bool_or(x1 <= 210) AND bool_or(x0 >= 390) THEN 300.0::DOUBLE END AS gutter FROM it GROUP BY ALL),
ro AS (SELECT it.*, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN gutter IS NULL OR (x0 + x1) / 2.0 < gutter THEN 0 ELSE 1 END, y0, x0, kind, seq) AS place FROM it JOIN gu USING (doc, page)),
o AS (SELECT *, row_number() OVER w - 1 AS ord, CASE WHEN kind = 'table' THEN 'table' WHEN is_heading THEN 'heading' ELSE 'paragraph' END AS block_type FROM ro WINDOW w AS (PARTITION BY doc ORDER BY page, place)),
q AS (SELECT *, block_type = 'paragraph' AND regexp_matches(text, '(?i)^(table|figure|fig\.)\s*\d+') AS says FROM o),
bl AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section,
  lag(says) OVER w AS said, lag(text) OVER w AS before, coalesce(lead(block_type) OVER w = 'table', false) AS table_next FROM q WINDOW w AS (PARTITION BY doc ORDER BY ord)),
rows_ AS (SELECT * FROM bl WHERE NOT (says AND table_next))"""
_LAYOUT = {
    "pdf_median_size": "SELECT doc, m AS median_size FROM md",
    "pdf_text_items": "SELECT doc, page, block, sha256(text) AS text_sha256, is_heading FROM th WHERE text <> ''",
    "pdf_outside_tables": "SELECT doc, page, block FROM th WHERE NOT inside AND text <> ''",
    "pdf_gutters": "SELECT doc, page, CASE WHEN NOT bool_or(x0 < 390 AND x1 > 210) AND bool_or(x1 <= 210) AND bool_or(x0 >= 390) THEN 300.0::DOUBLE END AS gutter FROM sp GROUP BY doc, page",
    "pdf_reading_order": "SELECT doc, page, kind, seq, place FROM ro",
    "pdf_pages_to_recognise": "SELECT doc, page FROM it GROUP BY doc, page HAVING sum(CASE WHEN kind = 'text' THEN length(text) ELSE 0 END) < 20",
    "pdf_block_rows": "SELECT doc, ord, page, block_type, sha256(text) AS text_sha256, coalesce(section, '') AS section, CASE WHEN block_type = 'table' AND said THEN sha256(before) END AS caption_sha256 FROM rows_",
    "quality_rollup": "SELECT doc, sum(length(text))::BIGINT AS chars_recovered, count(*) AS n_blocks, count(*) FILTER (block_type = 'table') AS tables_found FROM rows_ GROUP BY doc",
}

ORACLES = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 10",
    "vector_index_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 10",
    "lexical_simple_topk": f"WITH {_LEXICAL} SELECT query_id, chunk_id, score, rank FROM lexical WHERE rank <= 10",
    "indexed_topk": f"WITH {_LEXICAL} SELECT query_id, chunk_id, score, rank FROM lexical WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {_DENSE}, {_LEXICAL_BY_TEXT}, u AS (SELECT query_id, chunk_id, rank, 0 AS src FROM dense WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM lexical WHERE rank <= 40),
h AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(src * 1000000 + rank) AS seen FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM h) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10""",
    "retrieved_payload": f"""WITH {_DENSE} SELECT query_id, chunk_id, doc_id AS document_id, source AS source_document, text, score, rank FROM dense JOIN documents ON doc_id = chunk_id WHERE rank <= 10""",
    "rerank_topk": f"""WITH {_LEXICAL}, c AS (SELECT l.query_id, l.chunk_id, l.rank AS was, {_overlap('q.query', 'd.text')} AS score FROM lexical l JOIN q USING (query_id) JOIN documents d ON d.doc_id = l.chunk_id WHERE l.rank <= 15),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM c) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5""",
    "sentences": f"WITH {_ANSWERS}, {_SENTENCES} SELECT query_id, turn, i, sentence FROM s",
    "word_overlap": f"WITH {_ANSWERS} SELECT query_id, turn, rank, {_overlap('answer', 'text')} AS score FROM a JOIN g USING (query_id) WHERE rank <= turn",
    "ground_sentences": f"""WITH {_ANSWERS}, {_SENTENCES}, z AS (SELECT s.query_id, s.turn, s.i, s.sentence, g.rank, coalesce({_overlap('s.sentence', 'g.text')}, 0) AS score FROM s LEFT JOIN g ON g.query_id = s.query_id AND g.rank <= s.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, turn, i ORDER BY score DESC, rank) AS place FROM z)
SELECT query_id, turn, i, sentence, max(score) AS support_score, count(*) FILTER (score >= 0.4 AND rank IS NOT NULL) AS n_citations, count(*) FILTER (score >= 0.4 AND rank IS NOT NULL) > 0 AS grounded FROM r WHERE place <= 2 GROUP BY query_id, turn, i, sentence""",
    "prompt": f"""WITH {_ANSWERS}, f AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
p AS (SELECT query_id, string_agg('[' || rank || '] (talk)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM g GROUP BY query_id)
SELECT query_id, 'Answer from the passages only.' || chr(10) || chr(10) || coalesce(t, '') || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM f LEFT JOIN p USING (query_id)""",
    "flatten_spans": f"WITH {_BLOCKS} SELECT doc, ord, char_start, char_start + length(text) AS char_end FROM f",
    "naive_chunks": f"WITH d AS (SELECT doc_id AS doc, text FROM documents), w AS ({_WINDOWS.format('d')}) SELECT doc, char_start, char_end, part AS text, row_number() OVER (PARTITION BY doc ORDER BY char_start) - 1 AS chunk_index FROM w WHERE trim(part, {_SPACE}) <> ''",
    "naive_chunk_attribution": f"""WITH {_BLOCKS}, t AS (SELECT doc, string_agg(text, chr(10) ORDER BY ord) AS text FROM b GROUP BY doc), w AS ({_WINDOWS.format('t')}),
c AS (SELECT doc, char_start, char_end, row_number() OVER (PARTITION BY doc ORDER BY char_start) - 1 AS chunk_index FROM w WHERE trim(part, {_SPACE}) <> ''),
r AS (SELECT c.*, f.ord, row_number() OVER (PARTITION BY c.doc, c.chunk_index ORDER BY least(c.char_end, f.char_start + length(f.text)) - greatest(c.char_start, f.char_start) DESC, f.ord) AS k FROM c JOIN f ON c.doc = f.doc)
SELECT doc, chunk_index, char_start, char_end, ord FROM r WHERE k = 1""",
    "structure_chunks": f"""WITH RECURSIVE {_BLOCKS}, k AS (SELECT doc, ord, length(text) AS n, CASE WHEN ord % 9 = 0 THEN 'heading' WHEN ord % 11 = 0 THEN 'table' ELSE 'paragraph' END AS kind FROM b),
fold AS (SELECT doc, ord, kind, n AS chars, kind <> 'heading' AS content, 0 AS gid FROM k WHERE ord = 0
UNION ALL SELECT k.doc, k.ord, k.kind, CASE WHEN fresh THEN k.n ELSE fold.chars + k.n END, CASE WHEN fresh THEN k.kind <> 'heading' ELSE true END, fold.gid + fresh::INT
FROM fold JOIN k ON k.doc = fold.doc AND k.ord = fold.ord + 1, LATERAL (SELECT k.kind <> 'paragraph' OR fold.kind = 'table' OR (fold.content AND fold.chars + k.n > 1200) AS fresh)),
c AS (SELECT doc, gid, min(char_start) AS char_start, max(char_start + length(text)) AS char_end, bool_or(kind = 'table') AS from_table, sha256(string_agg(text, chr(10) ORDER BY ord)) AS text_sha256 FROM fold JOIN f USING (doc, ord) GROUP BY doc, gid HAVING bool_or(kind <> 'heading'))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY char_start) - 1 AS chunk_index, char_start, char_end, from_table, text_sha256 FROM c""",
    "content_hash_diff": f"""WITH {_STORED} SELECT p.source_path, CASE WHEN s.h IS NULL THEN 'new' WHEN s.h = p.h THEN 'skipped_unchanged' ELSE 'changed' END AS status FROM p LEFT JOIN s USING (source_path)""",
    "upsert_documents": f"""WITH {_STORED} SELECT p.source_path, CASE WHEN s.id IS NOT NULL THEN s.id ELSE (SELECT coalesce(max(id), 0) FROM s) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY p.source_path) END AS id, p.h AS content_hash FROM p LEFT JOIN s USING (source_path)""",
    "cascade_delete": f"""WITH {_BLOCKS}, gone AS (SELECT doc_id FROM labels WHERE quality = 0), n AS (SELECT doc, count(*) AS n FROM b GROUP BY doc)
SELECT doc_id + 1 AS id, 'doc-' || doc_id AS source_path, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN n ON n.doc = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)""",
    "replace_chunks": f"""WITH {_BLOCKS}, gone AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT doc + 1 AS document_id, ord AS chunk_index, sha256(text) AS text_sha256 FROM b WHERE doc NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id + 1, 0, sha256(coalesce(lang, '')) FROM documents JOIN gone USING (doc_id)""",
    "bucketed_chunks": f"""WITH {_BLOCKS}, gone AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT doc + 1 AS document_id, 'doc-' || doc AS source_document, ord AS chunk_index, sha256(text) AS text_sha256 FROM b WHERE doc NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id + 1, 'doc-' || doc_id, 0, sha256(coalesce(lang, '')) FROM documents JOIN gone USING (doc_id)""",
    "chunk_count": f"WITH {_BLOCKS} SELECT count(*) AS n FROM b",
    **{name: f"WITH {_BLOCKS}, {_LAID_OUT} {sql}" for name, sql in _LAYOUT.items()},
    "docx_block_rows": f"""WITH {_BLOCKS}, t AS (SELECT doc, ord, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g') AS text FROM b), u AS (SELECT doc, ord, trim(text, {_SPACE}) AS text FROM t WHERE trim(text, {_SPACE}) <> ''),
x AS (SELECT doc, ord AS was, CASE WHEN ord = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, text FROM u
UNION ALL SELECT doc, 1000000000000, 'table', 'id | ' || doc || chr(10) || ' | x' FROM b WHERE ord = 0 AND doc % 4 = 0),
y AS (SELECT *, row_number() OVER w - 1 AS ord, coalesce(first_value(CASE WHEN block_type = 'heading' THEN text END) OVER w, '') AS section, block_type = 'paragraph' AND regexp_matches(text, '(?i)^(table|figure|fig\\.)\\s*\\d+') AS says, lag(text) OVER w AS before, lag(block_type) OVER w AS kind_before, lead(block_type) OVER w AS kind_after FROM x WINDOW w AS (PARTITION BY doc ORDER BY was)),
z AS (SELECT *, lag(says) OVER (PARTITION BY doc ORDER BY was) AS said FROM y)
SELECT doc, ord, block_type, sha256(text) AS text_sha256, sha256(section) AS section_sha256, CASE WHEN block_type = 'table' AND said THEN sha256(before) END AS caption_sha256 FROM z WHERE NOT (says AND coalesce(kind_after = 'table', false))""",
    "naive_extraction": f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'unknown' ELSE 'plain_text' END AS doc_type, (trim(coalesce(text, ''), {_SPACE}) <> '')::BIGINT AS n_blocks,
length(trim(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), {_SPACE}))::BIGINT AS chars_recovered, (trim(coalesce(text, ''), {_SPACE}) = '')::BIGINT AS n_failures FROM documents""",
    "html_detect": """WITH h AS (SELECT page_id, lower(left(html, 4096)) AS t FROM pages)
SELECT page_id, 'html' AS doc_type, round(least(0.75::DOUBLE + 0.05::DOUBLE * least(contains(t, '<head')::INT + contains(t, '<body')::INT + contains(t, '<title')::INT + contains(t, '<div')::INT + contains(t, '<meta')::INT + contains(t, '<script')::INT + contains(t, '<p>')::INT + contains(t, '<a href')::INT, 5), 0.99::DOUBLE), 6) AS confidence
FROM h WHERE contains(left(t, 512), '<!doctype html') OR contains(left(t, 512), '<html')""",
    "text_detect": r"""WITH h AS (SELECT doc_id, left(coalesce(text, ''), 4096) AS t FROM documents), r AS (SELECT doc_id, t, length(regexp_replace(t, '[^\PC\n\r\t]|[^\PZ ]', '', 'g'))::DOUBLE / greatest(length(t), 1) AS r FROM h)
SELECT doc_id, CASE WHEN t <> '' AND r >= 0.95 THEN 'plain_text' ELSE 'unknown' END AS doc_type, CASE WHEN t = '' THEN 0.0::DOUBLE WHEN r >= 0.95 THEN round(least(0.6::DOUBLE + 0.3::DOUBLE * r, 0.99::DOUBLE), 3) ELSE 0.2::DOUBLE END AS confidence FROM r""",
    "caption_flags": f"WITH {_BLOCKS}, c AS (SELECT doc, ord, CASE WHEN doc % 5 = 0 THEN 'Table ' || doc || ': ' || text ELSE text END AS text FROM b) SELECT doc, ord, regexp_matches(text, '(?i)^(table|figure|fig\\.)\\s*\\d+') AS is_caption, lead(ord) OVER (PARTITION BY doc ORDER BY ord) AS next_ord FROM c",
    "hit_and_mrr": f"""WITH {_DENSE}, r AS (SELECT d.query_id, d.rank, c.label = q.label AS hit FROM dense d JOIN embeddings c ON c.vec_id = d.chunk_id JOIN embeddings q ON q.vec_id = d.query_id WHERE rank <= 10 AND chunk_id <> query_id)
SELECT query_id, coalesce(max(hit::INT), 0)::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6) AS rr FROM r GROUP BY query_id""",
    "nearest_rank_percentile": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value FROM o WHERE i = least(floor(n * 95 / 100), n - 1)",
    "doc_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "doc_list": "SELECT doc_id, lang, source, length(text)::BIGINT AS chars FROM documents ORDER BY doc_id",
}
