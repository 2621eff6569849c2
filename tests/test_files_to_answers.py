"""Files in, blocks, chunks, search, answers and the evaluation matrix."""

import json
import os

import pytest
from docloom.engine import Engine
from docloom.functions import english
from docloom.functions import text as fx
from docloom.operators import chunking, detection, evaluation, extraction, layout, models, retrieval, store
from docloom.sources import docx, files, pdf
from docloom.sources.html import blocks_of, read_html
from pyspark.sql import functions as F

PARTS = [(1, "Intro"), "Some first words.", (2, "Results"), "Table 1: numbers", [["Trial", "Outcome"], ["1", "alpha"], ["2", "beta"]], "The end."]


def table_pdf():
    return pdf.write_pdf([
        {"texts": [(16, 50, 40, "Results"), (10, 50, 80, "Table 1: trials"), (10, 55, 105, "Trial"), (10, 155, 105, "Outcome"), (10, 55, 125, "1"), (10, 155, 125, "alpha"), (10, 50, 200, "A closing sentence of the page.")],
         "lines": [(50, y, 250, y) for y in (100, 120, 140)] + [(x, 100, x, 140) for x in (50, 150, 250)]},
        {"texts": [(10, 60 + 350 * (i % 2), 50 + 30 * i, f"{'left' if i % 2 == 0 else 'right'} line {i} of text") for i in range(6)]},
        {},
    ])


def test_detection_of_files():
    assert detection.sniff(b"") == ("unknown", 0.0, ["empty_file"])
    assert detection.sniff(docx.write_docx(PARTS))[:2] == ("docx", 0.95)
    kind, confidence, signals = detection.sniff(table_pdf())
    assert kind == "pdf_text" and abs(confidence - 0.9) < 1e-9 and signals[-1] == "pages_with_text=2"
    assert detection.sniff(pdf.write_pdf([{}]))[:2] == ("pdf_scanned", 0.85)
    kind, confidence, signals = detection.sniff(b"%PDF-1.4 garbage")
    assert kind == "unknown" and confidence < 0.5 and any("pdf" in s for s in signals)
    assert detection.sniff(b"PK\x03\x04 broken")[:2] == ("unknown", 0.2)
    assert detection.sniff(b"<html><body>x")[0] == "html" and detection.sniff(b"a\0b")[0] == "unknown"
    assert detection.sniff(("x" * 4095 + "é" * 9).encode())[0] == "plain_text"
    assert detection.sniff("ab".encode("utf-16"))[0] == "unknown" and detection.decoded("héé".encode("latin-1")) == "héé"


def test_docx_keeps_order_and_captions():
    blocks, failures = docx.read_docx(docx.write_docx([*PARTS, [["", ""]]]))
    assert [b["block_type"] for b in blocks] == ["heading", "paragraph", "heading", "table", "paragraph"]
    table = blocks[3]
    assert table["caption"] == "Table 1: numbers" and table["section_path"] == ["Intro", "Results"] and table["table_rows"] == PARTS[4]
    assert table["text"] == "Trial | Outcome\n1 | alpha\n2 | beta" and failures == ["empty_table_at_order_6"]
    assert docx.all_text(docx.write_docx(PARTS)).endswith("The end.\nTrial Outcome\n1 alpha\n2 beta")


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><td>a<td>b<tr><td>c", [("table", "a | b\nc")]),
    ("<table><tr><td>a<p>x</p></td></tr></table>", [("table", "ax"), ("paragraph", "x")]),
    ("<p>Table 2: y<table><caption></caption><tr><td>a</table>", [("paragraph", "Table 2: y"), ("table", "a")]),
    ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", [("table", "ab | b\nb"), ("table", "b")]),
    ("<h1>A</h1>loose<div>text</div><p>one<p>two", [("heading", "A"), ("paragraph", "one"), ("paragraph", "two")]),
    ("<table><tr></tr></table>", []),
])
def test_html_without_end_tags(page, want):
    assert [(b[0], b[1]) for b in blocks_of(page)] == want
    if not want:
        assert read_html(page)[1] == ["empty_table_at_order_0"]


def as_files(spark, rows):
    return spark.createDataFrame(rows, "source_path string, content binary")


def test_router(spark):
    rows = [("a.docx", docx.write_docx(PARTS)), ("b.pdf", table_pdf()), ("c.html", b"<html><h1>T</h1><p>x</p></html>"), ("d.txt", b"one\r\n\r\ntwo\n\n\n"), ("e.bin", b"a\0b"), ("f.txt", b""), ("g", None), ("h.txt", b" \n\n ")]
    got = {r["source_path"]: r for r in extraction.extract(as_files(spark, rows)).collect()}
    assert {k: r["doc_type"] for k, r in got.items()} == {"a.docx": "docx", "b.pdf": "pdf_text", "c.html": "html", "d.txt": "plain_text", "e.bin": "unknown", "f.txt": "unknown", "g": "unknown", "h.txt": "plain_text"}
    assert [b["text"] for b in got["d.txt"]["blocks"]] == ["one", "two"] and got["d.txt"]["quality"]["chars_recovered"] == 6
    assert got["h.txt"]["quality"]["extraction_failures"] == ["no_paragraphs_recovered"] and got["g"]["quality"]["extraction_failures"] == ["read_error"]
    page = got["b.pdf"]["blocks"]
    assert [(b["block_type"], b["page"]) for b in page[:3]] == [("heading", 1), ("table", 1), ("paragraph", 1)]
    assert page[1]["table_rows"] == [["Trial", "Outcome"], ["1", "alpha"]] and page[1]["caption"] == "Table 1: trials" and page[1]["section_path"] == ["Results"]
    assert [b["text"].split()[0] for b in page[3:]] == ["left"] * 3 + ["right"] * 3
    quality = got["b.pdf"]["quality"]
    assert quality["pages_total"] == 3 and quality["pages_needing_ocr"] == 1 and quality["extraction_failures"] == ["page_3_ocr_failed: tesseract_not_installed"] and quality["tables_found"] == 1
    read = extraction.extract(as_files(spark, rows[1:2]), ocr=lambda pages: pages.withColumn("text", F.lit("seen text"))).first()
    assert read["quality"]["pages_ocr_recovered"] == 1 and read["blocks"][-1]["from_ocr"]
    flat = {r["source_path"]: r for r in extraction.extract(as_files(spark, rows), "naive").collect()}
    assert flat["c.html"]["blocks"][0]["text"] == "T x" and len(flat["b.pdf"]["blocks"]) == 1 and flat["h.txt"]["quality"]["extraction_failures"] == ["no_content_recovered"]
    with pytest.raises(ValueError):
        extraction.extract(as_files(spark, rows), "none")


def test_layout_over_tables(spark):
    spans = [("d", 1, 0, 0, 0, "Big  title", 20.0, 10.0, 10.0, 90.0, 30.0), ("d", 1, 1, 0, 0, "in the", 10.0, 10.0, 100.0, 60.0, 110.0), ("d", 1, 1, 1, 0, "table", 10.0, 10.0, 110.0, 60.0, 120.0), ("d", 1, 2, 0, 0, " ", 99.0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 3, 0, 0, "Big but ends.", 20.0, 10.0, 300.0, 80.0, 320.0)]
    s = spark.createDataFrame(spans, "doc string, page int, block int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, 0.0, 105.0, 70.0, 130.0, [["a", None], [" ", None]])], "doc string, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>")
    p = spark.createDataFrame([("d", 1, 600.0), ("d", 2, 600.0)], "doc string, page int, width double")
    assert layout.median_sizes(s).first()["median_size"] == 15.0
    assert [r["text"] for r in layout.text_blocks(s).orderBy("block").collect()] == ["Big title", "in the table", "Big but ends."]
    assert [r["block"] for r in layout.outside_tables(layout.text_blocks(s), t).orderBy("block").collect()] == [0, 3]
    got = layout.pdf_blocks(s, t, p).orderBy("ord").collect()
    assert [(r["block_type"], r["text"], r["section_path"]) for r in got] == [("heading", "Big title", ["Big title"]), ("table", "a | ", ["Big title"]), ("paragraph", "Big but ends.", ["Big title"])]
    assert [r["page"] for r in layout.pages_to_recognise(layout.page_items(s, t), p).orderBy("page").collect()] == [2]
    assert layout.pdf_blocks(s.where("false"), t.where("false"), p).count() == 0


def test_english_stems_and_queries():
    stems = {"caresses": "caress", "ties": "tie", "cries": "cri", "hopping": "hop", "hoping": "hope", "generously": "generous", "subscriptions": "subscript", "enterprise": "enterpris", "agreed": "agre", "relational": "relat", "happily": "happili", "skies": "sky", "news": "news", "sensational": "sensat", "running": "run", "controlling": "control", "cats": "cat", "catches": "catch"}
    assert {w: english.stem(w) for w in stems} == stems
    places = {"cat": [1, 9], "mous": [4], "night": [5]}
    q = english.parse_query
    assert english.matches(q("cats"), places) and not english.matches(q("cats dog"), places) and english.matches(q("dog or cats"), places)
    assert not english.matches(q("cats -night"), places) and english.matches(q('"mouse night"'), {"mous": [4], "night": [5]}) and not english.matches(q('"night mouse"'), places)
    assert q("the of") == [] and not english.matches(q("the of"), places)
    assert abs(english.cover_density(q("cats"), places) - 0.2) < 1e-12
    assert abs(english.cover_density(q("mouse night"), places) - 0.1) < 1e-12
    assert abs(english.cover_density(q("cats mouse"), {"cat": [1], "mous": [4]}) - 0.1 / 3) < 1e-12


def test_english_search(spark):
    chunks = spark.createDataFrame([(1, "small pets such as cats"), (2, "Enterprise software subscriptions grew."), (3, "It rained on software"), (4, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "enterprise software subscription"), (2, "a small pet that catches mice"), (3, "software -enterprise"), (4, "the"), (5, "cat or rain"), (6, "-software"), (7, None)], "query_id long, query string")
    got = {}
    for r in retrieval.english(asked, chunks).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [2], 3: [3], 5: [1, 3], 6: [1, 4]}


def test_library_and_engine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Cats hunt mice at night.\n\nThey sleep by day.")
    (folder / "b.html").write_text("<html><h1>Software</h1><p>Enterprise software subscriptions grew in March.</p></html>")
    (folder / "empty.txt").write_text("")
    paths = [str(folder / n) for n in ("a.txt", "b.html", "empty.txt", "missing.txt")]
    engine = Engine(spark, str(tmp_path / "library"))
    first = {os.path.basename(r["source_path"]): r for r in engine.ingest(paths).collect()}
    assert {k: r["status"] for k, r in first.items()} == {"a.txt": "indexed", "b.html": "indexed", "empty.txt": "failed", "missing.txt": "failed"}
    assert first["a.txt"]["chunks_indexed"] == 1 and engine.library.count_chunks() == 2 and first["empty.txt"]["reason"].startswith("extraction_failed")
    before = {r["source_path"]: r for r in engine.documents().collect()}
    (folder / "a.txt").write_text("Dogs bark.")
    again = {os.path.basename(r["source_path"]): r["status"] for r in engine.ingest(paths[:2]).collect()}
    assert again == {"a.txt": "indexed", "b.html": "skipped_unchanged"}
    after = {r["source_path"]: r for r in engine.documents().collect()}
    assert after.keys() == before.keys() and all(after[p]["id"] == before[p]["id"] and after[p]["ingested_at"] == before[p]["ingested_at"] for p in after)
    assert after[paths[0]]["content_hash"] != before[paths[0]]["content_hash"] and after[paths[0]]["updated_at"] > before[paths[0]]["updated_at"]
    assert sorted(r["text"] for r in engine.chunks().collect()) == ["Dogs bark.", "Software\n\nEnterprise software subscriptions grew in March."]
    got = engine.query("enterprise software", k=3)
    assert got["retrieved"][0]["source_document"] == paths[1] and got["answer"]["sentences"][0]["grounded"] and got["answer"]["sentences"][0]["citations"][0]["document"] == paths[1]
    assert engine.query("zebra", strategy="lexical")["answer"] == {"raw_text": "", "sentences": [], "retrieved_chunk_ids": []}
    for bad in ({"question": ""}, {"question": "x", "k": 0}, {"question": "x", "k": 51}, {"question": "x", "strategy": "none"}):
        with pytest.raises(ValueError):
            engine.query(**bad)
    assert engine.document(after[paths[1]]["id"])["doc_type"] == "html"
    with pytest.raises(KeyError):
        engine.document(99)
    assert engine.delete(paths[1]) and not engine.delete(paths[1]) and engine.library.count_chunks() == 1 and engine.health()["documents"] == 1


def test_matrix(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "pets.txt").write_text("Cats hunt mice at night.")
    (corpus / "soft.html").write_text("<html><h1>Software</h1><p>Enterprise software subscriptions grew.</p></html>")
    (corpus / "_hidden.txt").write_text("software")
    (corpus / "below").mkdir()
    (corpus / "below" / "x.txt").write_text("software")
    questions = tmp_path / "questions.json"
    questions.write_text(json.dumps({"about": "x", "questions": [{"id": "q1", "question": "enterprise software", "expected_documents": ["soft.html"], "category": "factual", "more": 1}, {"id": "q2", "question": "cats mice", "expected_documents": ["pets.txt"], "category": "factual"}, {"id": "q3", "question": "zebra", "expected_documents": [], "category": "unanswerable"}]}, indent=1))
    asked = files.load_questions(spark, str(questions))
    assert asked.columns == ["id", "question", "expected_documents", "category"] and asked.count() == 3
    scanned = files.scan_corpus(spark, str(corpus))
    assert sorted(os.path.basename(r["source_path"]) for r in scanned.collect()) == ["pets.txt", "soft.html"]
    rows = evaluation.run_matrix(scanned, asked, str(tmp_path / "index"), 2, generator=models.ExtractiveGenerator(), said=lambda _: None)
    assert len(rows) == 16 and all(r["recall_at_k"] == 1.0 and r["n_graded"] == 2 and r["n_questions"] == 3 for r in rows)
    assert "recall@k" in files.results_table(rows)
    path = files.write_results(rows, str(tmp_path / "results"))
    with open(path) as a, open(tmp_path / "results" / "latest.csv") as b:
        assert a.read() == b.read()
    assert [evaluation.percentile([float(i) for i in range(40)], p) for p in (50, 95)] == [20.0, 38.0] and evaluation.percentile([], 50) == 0.0


def test_sql_functions(spark):
    fx.register(spark)
    row = spark.sql("SELECT size(split_sentences('One. Two! Three?')) AS n, overlap_score('cats hunt', 'cats') AS o, round(cosine_similarity(array(1D, 0D), array(1D, 1D)), 4) AS c, detect_type(cast('plain words' AS binary)) AS t").first()
    assert tuple(row) == (3, 0.5, 0.7071, "plain_text")
    assert [r["text"] for r in spark.sql("SELECT * FROM html_blocks('<h1>A</h1><p>b')").collect()] == ["A", "b"]
    assert spark.sql("SELECT size(split_sentences('One. Two.')) AS n").first()["n"] == 2


def test_store_tables(spark):
    stored = spark.createDataFrame([(1, "a", "h1")], "id long, source_path string, content_hash string")
    new = spark.createDataFrame([("b", "h2"), ("b", "h3"), (None, "h4"), ("a", "h5"), ("c", "h6")], "source_path string, content_hash string")
    assert sorted(tuple(r) for r in store.upsert(stored, new).select("source_path", "id", "content_hash").collect()) == [("a", 1, "h5"), ("b", 2, "h3"), ("c", 3, "h6")]
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "document_id long, chunk_index long, text string")
    replaced = store.replace_chunks(chunks, spark.createDataFrame([(1, 0, "new")], chunks.schema))
    assert sorted(tuple(r) for r in replaced.collect()) == [(1, 0, "new"), (2, 0, "z")]
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "id long, source_path string")
    left, kept = store.cascade(documents, chunks, spark.createDataFrame([("a",), ("z",)], "source_path string"))
    assert [r["id"] for r in left.collect()] == [2] and [r["document_id"] for r in kept.collect()] == [2]
    ranks = store.numbered(spark.createDataFrame([(x,) for x in "hgfedcba"], "p string"), "p", "n").orderBy("n").collect()
    assert [(r["p"], r["n"]) for r in ranks] == [(c, i) for i, c in enumerate("abcdefgh", 1)]


def test_chunk_documents_tell_page_and_path(spark):
    blocks = extraction.blocks_of(extraction.extract(as_files(spark, [("a.docx", docx.write_docx(PARTS)), ("e.txt", b"")])))
    rows = chunking.chunk_documents(blocks).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["Intro\n\nSome first words.", "Trial | Outcome\n1 | alpha\n2 | beta", "The end."] and rows[1]["section_path"] == ["Intro", "Results"] and rows[1]["from_table"]
    whole = chunking.chunk_documents(blocks, "naive").collect()
    assert len(whole) == 1 and whole[0]["strategy"] == "naive_fixed_size" and whole[0]["char_start"] == 0
