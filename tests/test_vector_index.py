"""The vector index against the search that compares all pairs."""

import numpy as np
import pytest
from docloom.operators import retrieval, vectors
from pyspark.sql import functions as F

HITS = ["query_id", "chunk_id", "score", "rank"]
SCHEMA = "chunk_id long, embedding array<double>"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def odd(dim):
    """Vectors that are not to be found, and null ids."""
    return [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [float("nan")] * dim), (9005, [1.0] * (dim + 1)), (9006, [None] * dim), (None, [1.0] * dim)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 7))
    v = centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 7)) * 0.3
    v[100:400] = v[100]  # a group of copies
    v[400:420] = v[100] * 3  # of the same direction
    made = [(i * 3 - 50, x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(made + odd(7), SCHEMA).withColumn("list", F.lit("clash")).withColumn("batch", F.lit(1))


@pytest.fixture(scope="module")
def asked(corpus):
    some = corpus.where("chunk_id IS NULL OR chunk_id > 9000 OR chunk_id % 5 = 0").withColumn("chunk_id", F.coalesce("chunk_id", F.lit(8000)))
    return some.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@pytest.fixture(scope="module")
def made(spark, corpus, tmp_path_factory):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "ROWS", 32)
        index = vectors.VectorIndex(spark, f"{tmp_path_factory.mktemp('vectors')}/index")
        with pytest.raises(ValueError, match="fit"):
            index.add(corpus)
        index.fit(corpus)
        assert index.search(corpus.selectExpr("chunk_id AS query_id", "embedding AS query_embedding")).collect() == []
        for part in range(3):
            index.add(corpus.where(F.abs("chunk_id") % 3 == part).unionByName(corpus.where("chunk_id IS NULL")))
    return index


@pytest.mark.parametrize("k, wave", [(1, 1), (10, 2), (10, 8), (400, 1), (1000, 3)])
def test_bounds_lose_no_hit(monkeypatch, corpus, asked, made, k, wave):
    monkeypatch.setattr(vectors, "WAVE", wave)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    real = corpus.where("chunk_id IS NOT NULL")
    got = rows(made.search(asked, k), *HITS)
    assert got == rows(retrieval.dense(asked.where("size(query_embedding) = 7"), real, k), *HITS) and got


def test_candidates_by_shuffle_are_the_same(monkeypatch, asked, made):
    want = rows(made.search(asked, 5), *HITS)
    monkeypatch.setattr(vectors, "BROADCAST_CANDIDATES", 0)
    assert rows(made.search(asked, 5), *HITS) == want


def test_removed_rows_give_no_hits_and_no_limits(spark, tmp_path, monkeypatch, corpus, asked):
    monkeypatch.setattr(vectors, "ROWS", 32)
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.fit(corpus)
    real = corpus.where("chunk_id < 9000")
    index.add(real.where("chunk_id < 1000"))
    index.add(real.where("chunk_id >= 1000"))
    gone = real.where("chunk_id BETWEEN 200 AND 900 OR chunk_id % 2 = 0").select("chunk_id")  # the first copies are among them
    index.remove(gone)
    index.remove(gone.limit(0))
    queries = asked.where("size(query_embedding) = 7")
    want = rows(retrieval.dense(queries, real.join(gone, "chunk_id", "left_anti"), 10), *HITS)
    assert rows(index.search(queries, 10), *HITS) == want
    assert rows(vectors.VectorIndex(spark, f"{tmp_path}/index").search(queries, 10), *HITS) == want


def test_an_addition_that_broke_off_is_not_found(spark, tmp_path, monkeypatch, corpus, asked):
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.fit(corpus)
    real = corpus.where("chunk_id < 9000")
    write = vectors.VectorIndex._write
    monkeypatch.setattr(vectors.VectorIndex, "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(real)
    monkeypatch.setattr(vectors.VectorIndex, "_write", write)
    queries = asked.where("size(query_embedding) = 7")
    assert index.search(queries, 3).collect() == []
    index.add(real)
    index.remove(real.limit(0).select("chunk_id"))
    assert rows(index.search(queries, 3), *HITS) == rows(retrieval.dense(queries, real, 3), *HITS)


def test_probes_and_recall(corpus, asked, made):
    queries = asked.where("size(query_embedding) = 7")
    exact = retrieval.dense(queries, corpus.where("chunk_id < 9000"), 10)
    n, one, all_lists = 0, 0, 0
    for probes in (1, 10_000):
        counted = vectors.recall(made.search(queries, 10, probes), exact).agg(F.sum("n"), F.sum("n_found")).first()
        n, one, all_lists = counted[0], one or counted[1], counted[1]
    assert 0 < one <= n == all_lists


def test_clusters_beyond_the_limit_are_not_visited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "WAVE", 1)
    rng = np.random.default_rng(1)
    v = np.repeat(np.eye(8), 100, axis=0) + rng.normal(size=(800, 8)) * 0.02
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.fit(chunks, 8)
    index.add(chunks)
    seen = []
    visits = vectors.VectorIndex._visits
    monkeypatch.setattr(vectors.VectorIndex, "_visits", lambda self, *a: seen.append(visits(self, *a)) or seen[-1])
    queries = chunks.where("chunk_id % 100 = 5").selectExpr("chunk_id AS query_id", "embedding AS query_embedding")
    assert rows(index.search(queries, 10), *HITS) == rows(retrieval.dense(queries, chunks, 10), *HITS)
    assert len(seen) == 2 and seen[0].count() >= 1 and seen[1].count() < 56  # of 8 queries and 7 other lists


def test_nothing_to_fit_and_bad_values(spark, tmp_path):
    none = spark.createDataFrame(odd(3)[:3], SCHEMA)
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.fit(none)
    index.add(none)
    assert index.search(none.selectExpr("chunk_id AS query_id", "embedding AS query_embedding")).collect() == []
