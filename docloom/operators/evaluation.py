"""Hit at k, reciprocal rank and the nearest-rank percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """expected: query_id, expected (array); retrieved: query_id, rank, source. Null metrics where nothing is expected."""
    found = retrieved.groupBy("query_id").agg(F.collect_list(F.struct("rank", "source")).alias("r"))
    joined = expected.join(found, "query_id", "left")
    hits = F.filter(F.coalesce("r", F.array().cast("array<struct<rank:bigint,source:string>>")), lambda x: F.array_contains(F.col("expected"), x["source"]))
    first = F.array_min(F.transform(hits, lambda x: x["rank"]))
    graded = F.size("expected") > 0
    return joined.select("query_id", F.when(graded, F.when(F.size(hits) > 0, 1.0).otherwise(0.0)).alias("hit"), F.when(graded, F.coalesce(1 / first, F.lit(0.0))).alias("rr"))


def nearest_rank(values: DataFrame, keys: list[str], column: str, percent: int) -> DataFrame:
    """Of each group the value at place min(floor(n p / 100), n - 1), from 0, by counting equal values; no group is gathered."""
    from pyspark.sql.window import Window

    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys)
    below = F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("n", F.sum("c").over(whole)).withColumn("below", below)
    place: Column = F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1)
    return placed.where((F.col("below") > place) & (F.col("below") - F.col("c") <= place)).select(*keys, F.col("v").alias("value"))


def percentile(values: list[float], percent: float) -> float:
    """The nearest rank among a few values; 0.0 without any."""
    return sorted(values)[min(int(len(values) * percent / 100), len(values) - 1)] if values else 0.0


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group: questions, graded ones, and the means of hit and reciprocal rank over those; 0.0 where none is graded."""
    return metrics.groupBy(*keys).agg(F.count("*").alias("n_questions"), F.count("hit").alias("n_graded"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def config_id(extraction: str, chunking: str) -> str:
    return f"{extraction}-{chunking}"


def index_corpus(files: DataFrame, extraction: str, chunking: str, embedder, path: str, ocr=None) -> int:
    """Writes the chunks of one configuration in place of those before, as a partition of the table at path; how many there are."""
    from docloom.operators.chunking import chunk_documents
    from docloom.operators.extraction import blocks_of, extract
    from docloom.operators.models import embedded
    from docloom.operators.store import numbered

    found = extract(files, extraction, ocr)
    chunks = chunk_documents(blocks_of(found), chunking).join(found.select(F.col("source_path").alias("doc"), "doc_type"), "doc")
    chunks = numbered(embedded(chunks, "text", embedder).withColumn("place", F.struct("doc", "chunk_index")), "place", "chunk_id").drop("place")
    out = f"{path}/config_id={config_id(extraction, chunking)}"
    chunks.withColumnRenamed("doc", "source_path").write.mode("overwrite").parquet(out)
    return files.sparkSession.read.parquet(out).count()


def indexed(spark, path: str, config: str) -> DataFrame:
    """The chunks of one configuration, in the shape that searches take; only its partition is read."""
    rows = spark.read.parquet(path).where(F.col("config_id") == config)
    return rows.withColumn("document_id", F.lit(0).cast("long")).withColumnRenamed("source_path", "source_document")


EXTRACTIONS, CHUNKINGS, RETRIEVALS, RERANKS = ("naive", "structure_aware"), ("naive", "structure_aware"), ("dense", "hybrid"), (False, True)


def run_matrix(files: DataFrame, questions: DataFrame, path: str, k: int = 5, embedder=None, generator=None, scorer=None, said=print) -> list[dict]:
    """A row for each of the 16 configurations; the corpus is indexed once for each extraction and chunking.

    Latencies are those of one job over all questions, divided by their number: questions are not asked
    one by one. generator: also answers, with the shares of grounded answers and of unanswerable
    questions without one; their means are null without it.
    """
    import time

    from docloom.functions.text import basename
    from docloom.operators import answering, retrieval
    from docloom.operators.models import HashedEmbedder, embedded

    spark, embedder, rows = files.sparkSession, embedder or HashedEmbedder(), []
    asked = embedded(questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.coalesce("expected_documents", F.array().cast("array<string>")).alias("expected")), "query", embedder, "query_embedding").cache()
    n = asked.count()
    for extraction in EXTRACTIONS:
        for chunking in CHUNKINGS:
            said(f"{config_id(extraction, chunking)}: {index_corpus(files, extraction, chunking, embedder, path)} chunks")
            chunks = indexed(spark, path, config_id(extraction, chunking)).cache()
            for strategy in RETRIEVALS:
                for reranked in RERANKS:
                    began = time.monotonic()
                    found = retrieval.with_payload(retrieval.search(strategy, asked, chunks, k, reranked, scorer=scorer), chunks).cache()
                    found.count()
                    each = 1000 * (time.monotonic() - began) / max(1, n)
                    graded = retrieval_metrics(asked, found.select("query_id", F.col("rank").cast("long").alias("rank"), basename(F.col("source_document")).alias("source")))
                    row = {"extraction": extraction, "chunking": chunking, "retrieval": strategy, "rerank": reranked, **summary(graded, []).first().asDict()}
                    row |= {"latency_p50_ms": percentile([each] * n, 50), "latency_p95_ms": percentile([each] * n, 95), "groundedness_rate": None, "unanswerable_decline_rate": None, "avg_response_tokens": None}
                    if generator is not None:
                        row |= answering.graded(answering.answer(asked, found, generator), asked)
                    rows.append(row | {"total_wall_seconds": time.monotonic() - began})
                    found.unpersist()
            chunks.unpersist()
    asked.unpersist()
    return rows
