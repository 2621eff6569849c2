"""Work that several jobs share is done once."""

from pyspark.sql import functions as F

from docloom.operators import chunking, extraction
from docloom.sources import docx


def counted(spark, df, column):
    """df with a column passed through a function that counts its rows, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(values):
        seen.add(len(values))
        return values

    return df.withColumn(column, F.arrow_udf(pass_on, df.schema[column].dataType)(column)), seen


def test_files_are_read_once(spark):
    rows = [(f"{i}.docx", docx.write_docx([(1, f"Title {i}"), "text " * i])) for i in range(1, 41)]
    files, seen = counted(spark, spark.createDataFrame(rows, "source_path string, content binary").repartition(3), "content")
    found = extraction.extract(files)
    assert extraction.blocks_of(found).count() == 80 and found.where("quality.chars_recovered > 0").count() == 40
    assert seen.value == 40


def test_files_leave_a_task_by_number_and_by_bytes(spark, monkeypatch):
    rows = [(f"{i}.txt", b"" if i == 3 else f"text {i}".encode() * i) for i in range(11)] + [("gone", None)]
    files = spark.createDataFrame(rows, "source_path string, content binary").coalesce(1)
    want = sorted(map(str, extraction.extract(files).collect()))
    for number, size in ((1, 1), (4, 1 << 20), (256, 40)):
        monkeypatch.setattr(extraction, "FILES", number)
        monkeypatch.setattr(extraction, "FILE_BYTES", size)
        assert sorted(map(str, extraction.extract(files).collect())) == want and len(want) == 12


def test_lines_are_stripped_of_all_white_space(spark):
    text = "\x1f a \n　b \nä c\n d!\x85\n\x1c\n~\nz "
    got = [r["text"] for r in chunking.text_blocks(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text", "\n").orderBy("ord").collect()]
    assert got == ["a", "b", "ä c", "d!", "~", "z"]


def test_english_search_analyses_texts_once(spark, monkeypatch):
    from docloom.operators import retrieval

    texts = ["cats chase mice", "a cat sleeps", "the mouse and the cat", "dogs bark at night", None, "mice at night, mice by day", ""]
    asked = spark.createDataFrame([(1, "cats mouse"), (2, '"dog barks" or night -dog'), (3, "-cat"), (4, "the of"), (5, "unheard"), (6, None)], "query_id long, query string")
    for few, kept in ((100_000, 1 << 18), (0, 1)):  # queries by broadcast; by shuffle, with tasks that remember a word
        monkeypatch.setattr(retrieval, "BROADCAST_LEXEMES", few)
        monkeypatch.setattr(retrieval, "WORDS_KEPT", kept, raising=False)
        chunks, seen = counted(spark, spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), "text")
        got = {(r["query_id"], r["chunk_id"]) for r in retrieval.english(asked, chunks).collect()}
        assert got == {(1, 2), (2, 3), (2, 5), *[(3, i) for i in (3, 4, 5, 6)]}
        assert seen.value == len(texts)


def test_postings_are_counted_by_text_and_dealt_by_their_number(spark, monkeypatch):
    from docloom.operators import retrieval

    texts = [(1, "Red fox, red hen"), (2, "red hen"), (3, None), (2, "fox fox"), (None, "red fox"), (4, "hen é red fox"), (5, "")]
    chunks, seen = counted(spark, spark.createDataFrame(texts, "chunk_id long, text string").coalesce(1), "text")
    counts = {(r["chunk_id"], r["lexeme"]): r["tf"] for r in retrieval.counted_terms(chunks.where("chunk_id IN (1, 3, 4)"), frozenset(["red", "fox"])).collect()}
    assert counts == {(1, "red"): 2, (1, "fox"): 1, (4, "red"): 1, (4, "fox"): 1}
    asked = spark.createDataFrame([(1, "red FOX"), (2, "hen"), (3, "owl red")], "query_id long, query string")
    want = {(1, 1, 1, 0.3), (1, 2, 2, 0.3), (1, 4, 3, 0.2), (2, 1, 1, 0.1), (2, 2, 2, 0.1), (2, 4, 3, 0.1)}
    for few, most in ((100_000, 1 << 20), (0, 1)):
        monkeypatch.setattr(retrieval, "BROADCAST_LEXEMES", few)
        monkeypatch.setattr(retrieval, "PART_POSTINGS", most)
        assert {(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in retrieval.lexical(asked, chunks).collect()} == want


def test_scores_of_two_blocks_are_held_in_parts():
    import tracemalloc

    import numpy as np

    from docloom.operators import retrieval

    rng = np.random.default_rng(3)
    q, c = rng.standard_normal((600, 16)), rng.standard_normal((8192, 16))
    tracemalloc.start()
    got = [(a, b) for i, j, _ in retrieval._best(q, c, np.arange(len(c)), 3) for a, b in zip(i.tolist(), j.tolist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = q @ c.T / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((c * c).sum(1))
    assert sorted(got) == sorted((i, j) for i, row in enumerate(np.argsort(-near, axis=1)[:, :3].tolist()) for j in row)
    assert peak < 20 << 20


def test_an_index_deals_its_blocks_out_once(spark, monkeypatch):
    from docloom.operators import index

    monkeypatch.setattr(index, "PART_BYTES", 8)
    made = index.blocks(spark.createDataFrame([(i, f"red w{i} " * (i % 3 + 1)) for i in range(40)] + [(5000, "red"), (None, "red")], "chunk_id long, text string").repartition(3))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        where = made.select("bucket", F.pmod(F.xxhash64("lexeme", "win"), F.lit(index.FILES)).alias("file"), F.spark_partition_id().alias("p")).distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({(r["bucket"], r["file"]) for r in where}) == len(where) and len({r["p"] for r in where}) > 1
    got = {(r["lexeme"], r["win"]): (r["n"], r["most"]) for r in made.collect()}
    assert got[("red", 0)] == (40, 3) and got[("red", 1)] == (1, 1) and got[("w4", 0)] == (1, 2) and len(got) == 42
    assert all(r["bucket"] == spark.createDataFrame([(r["lexeme"],)], "l string").select(index.bucket("l")).first()[0] for r in made.where("lexeme IN ('red', 'w1')").collect())
