"""The inverted index against the search without one, and long threads against all pairs."""

import random

import pytest
from docloom.operators import answering, index, retrieval, threads
from pyspark.sql import functions as F

HITS = ["query_id", "chunk_id", "score", "rank"]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts(rng, n, step):
    words = ["a", "the", "of"] * 6 + [f"w{i}" for i in range(25)]
    return [(i * step - 40, None if i % 29 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(texts(random.Random(1), 600, 3), "chunk_id long, text string").withColumn("lexeme", F.lit("clash"))


@pytest.fixture(scope="module")
def asked(spark):
    some = ["a", "the of", "a THE w3", "w1 w2", "w4 w4 a", "the", "", None, "missing a", "w5, a; of the", "a the of w7 w8"]
    return spark.createDataFrame(list(enumerate(some)), "query_id long, query string")


def test_index_finds_what_the_plain_search_finds(spark, tmp_path, monkeypatch, corpus, asked):
    monkeypatch.setattr(index, "SPAN", 64)
    monkeypatch.setattr(index, "WAVE", 1)
    made = index.InvertedIndex(spark, f"{tmp_path}/index")
    assert made.search(asked).collect() == []
    for part in range(3):
        made.add(corpus.where(F.abs("chunk_id") % 3 == part).unionByName(corpus.where("chunk_id IS NULL")))
    for k in (1, 4, 1000):
        assert rows(made.search(asked, k), *HITS) == rows(retrieval.lexical(asked, corpus, k), *HITS)
    postings = rows(retrieval.postings(corpus), "chunk_id", "lexeme", "tf")
    assert rows(made.postings(), "chunk_id", "lexeme", "tf") == postings
    gone = corpus.where("chunk_id % 4 = 0").select("chunk_id")
    made.remove(gone)
    left = retrieval.lexical(asked, corpus.join(gone, "chunk_id", "left_anti"), 4)
    assert rows(made.search(asked, 4), *HITS) == rows(left, *HITS)
    before = made.blocks().count()
    made.compact()
    assert made.blocks().count() < before and made.removed().count() == 0
    assert rows(index.InvertedIndex(spark, f"{tmp_path}/index").search(asked, 4), *HITS) == rows(left, *HITS)


def test_a_broken_compaction_leaves_the_index_whole(spark, tmp_path, corpus, asked):
    made = index.InvertedIndex(spark, f"{tmp_path}/index")
    made.add(corpus)
    want = rows(made.search(asked, 4), *HITS)
    (tmp_path / "index" / "blocks").rename(tmp_path / "index" / "blocks-new")
    assert rows(index.InvertedIndex(spark, f"{tmp_path}/index").search(asked, 4), *HITS) == want


def test_windows_that_cannot_reach_the_limit_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 64)
    monkeypatch.setattr(index, "WAVE", 2)
    many = [(i, "x " * (50 if 640 <= i < 660 else 1 + i % 3) + "y") for i in range(64 * 40)]
    made = index.InvertedIndex(spark, f"{tmp_path}/index")
    made.add(spark.createDataFrame(many, "chunk_id long, text string"))
    read = []
    scored = index.InvertedIndex._scored
    monkeypatch.setattr(index.InvertedIndex, "_scored", lambda self, wanted, wins: read.append(wins.count()) or scored(self, wanted, wins))
    query = spark.createDataFrame([(1, "y x")], "query_id long, query string")
    assert [r["chunk_id"] for r in made.search(query, 10).orderBy("rank").collect()] == list(range(640, 650))
    assert read == [2, 0]  # of 40


def test_index_reads_only_its_lexemes(spark, tmp_path, corpus):
    made = index.InvertedIndex(spark, f"{tmp_path}/index")
    made.add(corpus)
    wanted = spark.createDataFrame([(1, "a", 1)], "query_id long, lexeme string, need long")
    plan = made._of(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "SortMergeJoin" not in plan


def thread_rows(rng, turns):
    words = ["the", "and", "of"] * 4 + [f"t{i}" for i in range(60)]
    talk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    said, told = [], []
    for thread, n in [("long", turns), ("short", 3), (None, 6), ("mute", 4)]:
        told += [(thread, r, rng.choice([talk(9), talk(3), None, "the and of", "!"])) for r in range(n) if thread != "mute"]
        said += [(thread, r, i, rng.choice([talk(7), talk(2), "...", None, "the"])) for r in range(n) for i in range(2)]
    return said, told + told[:3]


@pytest.mark.parametrize("block", [1, 2, 32])
def test_threads_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(threads, "BLOCK", block)
    said, told = thread_rows(random.Random(block), 90)
    sentences = spark.createDataFrame(said, "thread string, turn int, i long, sentence string")
    passages = spark.createDataFrame(told, "thread string, rank int, text string").withColumn("words", F.lit(1))
    keys = F.struct("thread", "turn").alias("query_id")
    before = sentences.select("thread", "turn").distinct().join(passages, "thread").where("rank <= turn").select(keys, "rank", "text")
    want = answering.ground(sentences.select(keys, "i", "sentence"), before)
    got = threads.ground_in_thread(sentences, passages)
    columns = ["i", "sentence", "support_score", "n_citations", "grounded"]
    assert rows(got, "thread", "turn", *columns) == rows(want, "query_id.thread", "query_id.turn", *columns)
    assert threads.ground_in_thread(sentences.limit(0), passages).collect() == []
    assert {tuple(r) for r in threads.ground_in_thread(sentences, passages.limit(0)).select("support_score", "n_citations", "grounded").collect()} == {(0.0, 0, False)}


def test_few_pairs_meet_in_long_threads(spark, monkeypatch):
    monkeypatch.setattr(threads, "BLOCK", 4)
    rng = random.Random(5)
    talk = lambda t: " ".join(["the", "and", "of", "to", "in"] + [f"u{rng.randrange(4000)}" for _ in range(8)])
    words = spark.createDataFrame([(r, talk(r)) for r in range(400)], "turn long, text string").select("turn", F.split("text", " ").alias("words"))
    passages = words.select(F.lit("x").alias("thread"), F.col("turn").alias("rank"), F.col("turn").alias("no"), "words")
    late = words.select(F.col("turn").alias("id"), F.lit("x").alias("thread"), "turn", "words", F.lit(5).alias("least"))
    seen = threads.far(late, passages)
    assert seen.count() <= 400
    plan = seen._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
