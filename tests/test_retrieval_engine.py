import pytest

from docloom.functions import text as fx
from docloom.operators import answering, chunking, detection, evaluation, retrieval, store
from docloom.sources.html import blocks_of
from pyspark.sql import functions as F


def test_sentences_and_overlap(spark):
    rows = spark.createDataFrame([("One. Two! Three?",), ("  ",), (None,)], "t string").select(fx.split_sentences(F.col("t"))).collect()
    assert [len(r[0]) for r in rows] == [3, 0, 0]
    pairs = spark.createDataFrame([("cats hunt mice", "cats hunt mice at night"), ("cats hunt mice", "quarterly revenue increased"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(fx.overlap_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_naive_chunks_cover_without_gaps(spark):
    text = "abcdefghij" * 13
    rows = chunking.naive_chunks(spark.createDataFrame([(1, text), (2, "  "), (3, "x")], "doc long, text string"), 40, 10).orderBy("doc", "chunk_index").collect()
    first = [r for r in rows if r["doc"] == 1]
    assert first[0]["char_start"] == 0 and first[-1]["char_end"] == len(text)
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in first)
    assert all(b["char_start"] <= a["char_end"] for a, b in zip(first, first[1:]))
    assert [r["doc"] for r in rows if r["doc"] != 1] == [3]


def test_structure_chunks(spark):
    blocks = [(1, 0, "heading", "H"), (1, 1, "table", "a | b"), (1, 2, "paragraph", "p" * 6), (1, 4, "paragraph", "q" * 5), (1, 5, "heading", "G"), (1, 6, "paragraph", "r" * 30), (1, 7, "heading", "end")]
    rows = chunking.structure_chunks(spark.createDataFrame(blocks, "doc long, ord long, block_type string, text string"), 10).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["a | b", "p" * 6, "q" * 5, "G\n\n" + "r" * 30]
    assert [r["chunk_index"] for r in rows] == [0, 1, 2, 3] and rows[0]["from_table"]
    flat = "\n\n".join(b[3] for b in blocks)
    assert all(flat[r["char_start"] : r["char_end"]] == r["text"] for r in rows)


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "small pets such as cats", [1.0, 0.0]), (2, "enterprise software subscriptions", [0.0, 1.0]), (3, "rain", [0.0, 0.0]), (4, None, None)], "chunk_id long, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "enterprise software", [0.0, 2.0]), (2, "a small pet that catches mice", [1.0, 1.0]), (3, "", None)], "query_id long, query string, query_embedding array<float>")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.lexical(queries, chunks).collect()] == [(1, 2)]
    found = retrieval.search("hybrid", queries, chunks, 5).where("query_id = 1").orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == [2, 1] and [r["rank"] for r in found] == [1, 2]
    assert retrieval.search("dense", queries, chunks, 1, True).count() == 2
    with pytest.raises(ValueError):
        retrieval.search("none", queries, chunks)


def test_grounding_threshold(spark):
    answers = spark.createDataFrame([(1, "cats hunt mice. Revenue fell.")], "query_id long, answer string")
    passages = spark.createDataFrame([(1, 1, "cats hunt"), (1, 2, "nothing")], "query_id long, rank long, text string")
    rows = answering.ground(answering.sentences(answers), passages).orderBy("i").collect()
    assert [(r["grounded"], r["n_citations"]) for r in rows] == [(True, 1), (False, 0)] or rows[0]["grounded"]


def test_metrics(spark):
    expected = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, [])], "query_id long, expected array<string>")
    found = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (2, 1, "x")], "query_id long, rank long, source string")
    assert [tuple(r) for r in evaluation.retrieval_metrics(expected, found).orderBy("query_id").collect()] == [(1, 1.0, 0.5), (2, 0.0, 0.0), (3, None, None)]
    values = spark.createDataFrame([("k", float(i)) for i in range(40)], "k string, v double")
    assert [evaluation.nearest_rank(values, ["k"], "v", p).first()["value"] for p in (50, 95)] == [20.0, 38.0]


def test_detection(spark):
    cases = [(b"", "unknown"), (b"%PDF-1.4 x", "pdf"), (b"PK\x03\x04..", "zip"), (b"\xef\xbb\xbf <!DOCTYPE html><p>x", "html"), (b"plain text", "plain_text"), (b"a\x00b", "unknown"), (("a" * 4095 + "é").encode(), "plain_text")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary").select("i", detection.detect(F.col("c")).alias("d")).orderBy("i")
    assert [r["d"]["doc_type"] for r in df.collect()] == [k for _, k in cases]


def test_html_blocks():
    got = blocks_of("<h1>Intro</h1><p>Hello <b>world</b></p><h2>Results</h2><p>Table 1: x</p><table><tr><th>a</th><td>b</td></tr><tr></tr></table><script>no</script><p>end")
    assert [(b[0], b[1]) for b in got] == [("heading", "Intro"), ("paragraph", "Helloworld"), ("heading", "Results"), ("table", "a | b"), ("paragraph", "end")]
    assert got[3][2] == ["Intro", "Results"] and got[3][3] == "Table 1: x"


def test_store(spark):
    stored = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id long, source_path string, content_hash string")
    new = spark.createDataFrame([("b", "h3"), ("c", "h4")], "source_path string, content_hash string")
    assert sorted(tuple(r) for r in store.upsert(stored, new).select("source_path", "id", "content_hash").collect()) == [("a", 1, "h1"), ("b", 2, "h3"), ("c", 3, "h4")]
    assert {r["source_path"]: r["status"] for r in store.changes(new, stored).collect()} == {"b": "changed", "c": "new"}
