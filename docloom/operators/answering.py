"""Prompts, answers by a given generator, and how sentences are grounded in passages by word overlap.

Null texts have no sentences; a query without passages has an empty answer and asks no generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import overlap_score, split_sentences

THRESHOLD, CITATIONS = 0.4, 2


def sentences(answers: DataFrame) -> DataFrame:
    """query_id, answer: a row for each sentence with its place."""
    return answers.select("query_id", F.posexplode(split_sentences(F.col("answer"))).alias("i", "sentence")).select("query_id", F.col("i").cast("long").alias("i"), "sentence")


def ground(found: DataFrame, passages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sentences with the passages (query_id, rank, text) that support them: of the best CITATIONS those that reach the threshold."""
    pairs = found.join(passages, "query_id", "left").withColumn("score", F.round(F.coalesce(overlap_score(F.col("sentence"), F.col("text")), F.lit(0.0)), 6))
    place = F.row_number().over(Window.partitionBy("query_id", "i").orderBy(F.desc("score"), "rank"))
    best = pairs.withColumn("place", place).where(F.col("place") <= CITATIONS)
    cited = F.count_if((F.col("score") >= threshold) & F.col("rank").isNotNull())
    return best.groupBy("query_id", "i", "sentence").agg(F.max("score").alias("support_score"), cited.alias("n_citations"), (cited > 0).alias("grounded"))


#: The words around the passages.
BEFORE = "Answer from the passages only."


def prompts(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and the numbered passages (rank, source and, if there is one, page; text), then the question."""
    place = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("source"))
    if "page" in passages.columns:
        place = F.concat(place, F.coalesce(F.concat(F.lit(", page "), F.col("page").cast("string")), F.lit("")))
    line = F.concat(place, F.lit(")\n"), F.col("text"))
    body = passages.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("p"))
    joined = queries.join(body, "query_id", "left")
    text = F.array_join(F.transform("p", lambda x: x["l"]), "\n\n")
    return joined.select("query_id", F.concat(F.lit(BEFORE + "\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def citations(found: DataFrame, passages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each sentence (query_id, i, sentence) with grounded, support_score and the citations of passages with their payload."""
    pairs = found.join(passages, "query_id", "left").withColumn("score", F.coalesce(overlap_score(F.col("sentence"), F.col("text")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query_id", "i").orderBy(F.desc("score"), "rank"))
    best = pairs.withColumn("place", place).where(F.col("place") <= CITATIONS)
    cited = F.when((F.col("score") >= threshold) & F.col("chunk_id").isNotNull(), F.struct("place", F.col("source_document").alias("document"), "page", "char_start", "char_end", "chunk_id"))
    rows = best.groupBy("query_id", "i", "sentence").agg(F.max("score").alias("support_score"), F.sort_array(F.collect_list(cited)).alias("c"))
    shown = F.transform("c", lambda x: F.struct(x["document"].alias("document"), x["page"].alias("page"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), x["chunk_id"].alias("chunk_id")))
    return rows.select("query_id", "i", "sentence", (F.size("c") > 0).alias("grounded"), "support_score", shown.alias("citations"))


def answer(queries: DataFrame, found: DataFrame, generator, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, raw_text, sentences (text, grounded, support_score, citations) and retrieved_chunk_ids for queries and their retrieved rows with payload."""
    from docloom.operators.models import generated

    had = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
    asked = prompts(queries.join(had, "query_id", "left_semi"), found.withColumn("source", F.col("source_document")))
    said = asked.select("query_id", generated(F.col("prompt"), generator).alias("answer"))
    rows = citations(sentences(said), found, threshold)
    told = rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("sentence").alias("text"), "grounded", "support_score", "citations"))), lambda x: F.struct(x["text"].alias("text"), x["grounded"].alias("grounded"), x["support_score"].alias("support_score"), x["citations"].alias("citations"))).alias("sentences"))
    return queries.select("query_id", "query").join(said, "query_id", "left").join(told, "query_id", "left").join(had, "query_id", "left").select("query_id", "query", F.coalesce("answer", F.lit("")).alias("raw_text"), "sentences", "retrieved_chunk_ids")


def graded(answers: DataFrame, asked: DataFrame) -> dict:
    """Shares over all questions with passages, and over those without an expected document that none was grounded; a question without passages counts in the second only."""
    some = F.coalesce(F.exists("sentences", lambda s: s["grounded"]), F.lit(False))
    empty, unanswerable = F.col("retrieved_chunk_ids").isNull(), F.size("expected") == 0
    rows = answers.join(asked.select("query_id", "expected"), "query_id")
    declined = F.when(empty, unanswerable.cast("double")).when(unanswerable, (~some).cast("double"))
    tokens = F.when(~empty, F.size(F.filter(F.split("raw_text", r"\s+"), lambda w: w != "")))
    return rows.agg(F.avg(F.when(~empty, some.cast("double"))).alias("groundedness_rate"), F.avg(declined).alias("unanswerable_decline_rate"), F.avg(tokens).alias("avg_response_tokens")).first().asDict()
