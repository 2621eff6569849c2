"""Rows that repeat a key, ids of other types, clashing names."""

import hashlib

from docloom.llm import blocks, warc
from docloom.llm._shared import new_folder
from pyspark.sql import functions as F


def test_keep_exact_tells_rows_apart(spark):
    rows = [(1, "a b c", 1), (1, "a\nb  c", 2), (1, "other", 3), (2, "a b c", 4), (None, "a b c", 5), (None, None, 6), (3, "", 7), (4, "x" * 3000, 8), (5, "x" * 3000, 9), (6, "x" * 3001, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumn("_stay", F.lit(1)).withColumn("_sha", F.lit(2)).withColumn("name", F.lit("n"))
    got = blocks.keep_exact(docs)
    assert got.columns == docs.columns
    kept = sorted(r["row"] for r in got.collect())
    assert kept in ([1, 3, 7, 8, 10], [2, 3, 7, 8, 10])
    assert blocks.keep_exact(docs.where("false")).count() == 0
    groups = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in blocks.exact_groups(docs).collect())
    assert [g for g in groups if g[0] == 1] in ([(1, 1, 1, True), (1, 1, 5 - 1, False), (1, 1, 4, True)], [(1, 1, 1, True), (1, 1, 4, False), (1, 1, 4, True)])
    assert sum(g[3] for g in groups) == 5


def archive(spark, rows, ddl, id_type="long"):
    path = new_folder(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, ddl), path)
    return warc.parsed(warc.read_archive(spark, path), id_type).collect()


def test_repeated_page_ids_have_one_response(spark):
    page = "p" * 150
    got = archive(spark, [(1, "u", page, 9), (1, "u", page, 8), (1, "t", page, 7), (2, None, page, 6), (None, "u", page, 5), (1, "u", "small", 4), (1, "u", "small", 3)], "page_id long, url string, html string, digest int")
    large = [r for r in got if r["payload_bytes"] == 150]
    assert sorted(r["record_type"] for r in large) == ["response"] + ["revisit"] * 4
    assert [(r["page_id"], r["url"], r["refers_to"]) for r in large if r["record_type"] == "response"] == [(1, "t", None)]
    assert {r["refers_to"] for r in large if r["record_type"] == "revisit"} == {1}
    assert [r["record_type"] for r in got if r["payload_bytes"] == 5] == ["response"] * 2
    assert {r["payload_digest"] for r in large} == {hashlib.sha256(page.encode()).hexdigest()}
    assert sorted(str(r["page_id"]) for r in got) == ["1"] * 5 + ["2", "None"]


def test_ids_and_urls_come_back_as_they_were(spark):
    urls = ["http://a/b", "a b", "a%20b", "x\r\nWARC-Type: y", "tab\there", "ctl\x01", None, "ü", "p+q"]
    ids = ["none", "a>b", "é ü", "7", "-1", "\r\n", "", "a:b", "%41"]
    got = archive(spark, [(i, u, "h" * k) for k, (i, u) in enumerate(zip(ids, urls))], "page_id string, url string, html string", "string")
    assert {r["payload_bytes"]: (r["page_id"] or "", r["url"]) for r in got} == {k: (i, u) for k, (i, u) in enumerate(zip(ids, urls))}
    assert archive(spark, [], "page_id long, url string, html string") == []
