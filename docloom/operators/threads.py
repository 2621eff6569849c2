"""Sentences grounded in what was said before them, where threads may be long.

A sentence's support is the share of its words that a passage has. Only the two best passages count, so
not every pair has to meet. Passages of a thread lie in blocks of BLOCK ranks; a sentence meets the block
of its own place and the one before as arrays, and the second best found there is its limit. A passage
further back matters only if it has as many of the sentence's words as the limit says, so it must have one
of the sentence's words beyond the limit's number less one. The rarest of the thread are taken for these,
and pairs that share one of them are looked at in full.

Defined results: the same rows as answering.ground with the passages of each thread up to a sentence's
turn. Null texts have no words. A sentence without words or passages has support 0 and no citation.
Null threads have no passages. A rank that repeats counts once for each row. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import word_set
from docloom.operators.answering import CITATIONS, THRESHOLD

BLOCK = 32


def _shared(words: Column, others: Column) -> Column:
    return F.size(F.array_intersect(words, others))


def _best(found: Column) -> Column:
    """The CITATIONS best of structs of minus the number of shared words, the rank, and the row's number."""
    return F.slice(F.array_sort(found), 1, CITATIONS)


def near(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """sentences (id, thread, turn, words) with `best` of the passages (thread, rank, no, words) of the block of their turn and the one before."""
    blocks = passages.groupBy("thread", F.expr(f"rank div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("rank", "no", "words")).alias("p"))
    here = F.expr(f"turn div {BLOCK}")
    met = sentences.withColumn("block", F.explode(F.array(here, here - 1))).join(blocks, ["thread", "block"])
    scored = F.transform(F.filter("p", lambda x: x["rank"] <= F.col("turn")), lambda x: F.struct((-_shared(F.col("words"), x["words"])).alias("less"), x["rank"].alias("rank"), x["no"].alias("no")))
    return met.select("id", _best(scored).alias("best"))


def far(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """id and `best` of pairs further back that can be among the best. sentences: id, thread, turn, words, least (shared words of the second best so far)."""
    postings = passages.select("thread", "rank", "no", F.explode("words").alias("word"))
    often = postings.groupBy("thread", "word").agg(F.count("*").alias("df"))
    late = sentences.where(f"turn >= {2 * BLOCK}").withColumn("need", F.greatest("least", F.lit(1)))
    each = late.where(F.size("words") >= F.col("need")).select("id", "thread", "turn", "need", "words", F.explode("words").alias("word")).join(often, ["thread", "word"])
    # words that no passage has are the rarest, so they come off the number first
    have = F.count("*").over(Window.partitionBy("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))
    rare = each.withColumn("have", have).withColumn("place", place).where("place <= have - need + 1")
    pairs = rare.select("id", "thread", "turn", "word").join(postings, ["thread", "word"]).where(f"rank < (turn div {BLOCK} - 1) * {BLOCK}").select("id", "thread", "rank", "no").distinct()
    full = pairs.join(passages.select("no", F.col("words").alias("others")), "no").join(sentences.select("id", "words", "least"), "id")
    scored = full.select("id", "rank", "no", _shared(F.col("words"), F.col("others")).alias("n"), "least").where("n >= least")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "rank", "no"))
    return scored.withColumn("place", place).where(F.col("place") <= CITATIONS).groupBy("id").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "rank", "no")).alias("best"))


def ground_in_thread(sentences: DataFrame, passages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sentences (thread, turn, i, sentence) with support_score, n_citations and grounded, by the passages (thread, rank, text) with a rank up to their turn."""
    from docloom.operators.store import _held

    said = _held(sentences.select("thread", F.col("turn").cast("long").alias("turn"), "i", "sentence", word_set(F.col("sentence")).alias("words"), F.monotonically_increasing_id().alias("id")))
    told = _held(passages.where("thread IS NOT NULL AND rank IS NOT NULL").select("thread", F.col("rank").cast("long").alias("rank"), word_set(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("no")))
    first = _held(near(said, told).groupBy("id").agg(_best(F.flatten(F.collect_list("best"))).alias("best")))  # of two blocks at most
    second = F.when(F.size("best") >= CITATIONS, -F.element_at("best", CITATIONS)["less"]).otherwise(0)
    limits = said.join(first.select("id", second.alias("least")), "id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    both = first.unionByName(far(limits, told)).groupBy("id").agg(_best(F.flatten(F.collect_list("best"))).alias("best"))
    score = F.transform("best", lambda x: F.round(-x["less"] / F.size("words"), 6))
    rows = said.join(both, "id", "left").withColumn("s", F.when(F.size("words") > 0, score))
    cited = F.coalesce(F.size(F.filter("s", lambda x: x >= threshold)), F.lit(0)).cast("long")
    return rows.select("thread", "turn", "i", "sentence", F.coalesce(F.array_max("s"), F.lit(0.0)).alias("support_score"), F.greatest(cited, F.lit(0)).alias("n_citations")).withColumn("grounded", F.col("n_citations") > 0)
