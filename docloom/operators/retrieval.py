"""Dense, lexical and hybrid retrieval for a table of queries, and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions.text import overlap_score

RRF_K, RRF_POOL, RERANK_POOL = 60, 4, 3
#: More distinct lexemes of queries than this (some 40 bytes each) are joined by shuffle instead of broadcast.
BROADCAST_LEXEMES = 100_000
#: Values in a block of vectors; pairs scored at once; pairs added up at once; parts of the queries where they are too many for a broadcast.
BLOCK_VALUES, SCORES, ROWS, QUERY_PARTS = 1 << 19, 1 << 18, 1 << 16, 8


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _vector_blocks(table: DataFrame, key: str, vector: str) -> DataFrame:
    """ids and vectors (as bytes of doubles) of up to BLOCK_VALUES values; without vectors that are null, empty, all zero or not finite."""
    most = BLOCK_VALUES
    schema = T.StructType([T.StructField("ids", T.ArrayType(table.schema[key].dataType)), T.StructField("dim", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim))
            ids, v = pa.concat_arrays(ids), np.concatenate(vectors)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([dim], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema.names)

        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.float64()))
            lengths = pc.fill_null(pc.list_value_length(lists), 0)
            for dim in pc.unique(lengths).to_pylist():
                if not dim:
                    continue
                of_dim = pc.equal(lengths, dim)
                ids, v = batch.column(0).filter(of_dim), lists.filter(of_dim).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                ids, v, rows = ids.filter(pa.array(good)), v[good], max(1, most // dim)
                while len(v):
                    room = rows - sum(len(x) for _, x in held.get(dim, ()))
                    held.setdefault(dim, []).append((ids[:room], v[:room]))
                    ids, v = ids[room:], v[room:]
                    if sum(len(x) for _, x in held[dim]) == rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return table.select(key, vector).mapInArrow(run, schema)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves of the shortest decimal form away from zero, as Spark rounds."""
    out, part = np.round(x, 6), np.abs(x) * 1e6 % 1
    for i in np.flatnonzero(np.abs(part - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of functions.text.cosine."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(q: np.ndarray, c: np.ndarray, place: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in q and in c and the scores of the k best of c for each of q; place: the order of c's ids."""
    q_norm, c_norm = np.sqrt(_dot(q, q)), np.sqrt(_dot(c, c))
    step = max(1, SCORES // len(c))
    for at in range(0, len(q), step):
        norm = q_norm[at : at + step, None] * c_norm
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.where(norm > 0, q[at : at + step] @ c.T / norm, -np.inf)
        least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k, None] if len(c) > k else -np.inf
        i, j = np.nonzero((near >= least - 3e-6) & (norm > 0))  # whatever rounding may place among the k best
        score = np.empty(len(i))
        for x in range(0, len(i), ROWS):
            part = slice(x, x + ROWS)
            score[part] = _rounded(_dot(c[j[part]], q[at + i[part]]) / (c_norm[j[part]] * q_norm[at + i[part]]))
        order = np.lexsort((place[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[first], j[first], score[first]


def dense(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """queries: query_id, query_embedding; chunks: chunk_id, embedding. All pairs, in blocks of vectors; a pair of blocks leaves its k best of each query.

    Null, empty, zero and not finite vectors find nothing.
    """
    left = _vector_blocks(chunks, "chunk_id", "embedding").toDF("chunks", "dim", "c")
    right = _vector_blocks(queries, "query_id", "query_embedding").repartition(QUERY_PARTS).toDF("queries", "of", "q")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk_ids, dim, c, query_ids, of, q = (batch.column(x)[row] for x in range(6))
                if dim.as_py() != of.as_py():
                    continue
                c, q = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim.as_py()) for x in (c, q))
                place = np.empty(len(c), np.int64)
                place[pc.sort_indices(chunk_ids.values).to_numpy()] = np.arange(len(c))
                for i, j, score in _best(q, c, place, k):
                    yield pa.RecordBatch.from_arrays([query_ids.values.take(pa.array(i)), chunk_ids.values.take(pa.array(j)), pa.array(score)], schema.names)

    return ranked(left.crossJoin(right).mapInArrow(run, schema), k)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, lexeme and its number of places, by the simple analyser."""
    words = chunks.select("chunk_id", F.explode(terms(F.col("text"))).alias("lexeme"))
    return words.groupBy("chunk_id", "lexeme").agg(F.count("*").alias("tf"))


#: Postings that a task of a join sorts, on average, however many there are.
PART_POSTINGS = 1 << 20
#: What the simple analyser takes as a word of a lower-cased text; texts that a task analyses at once.
_TERM, TEXTS = re.compile("[a-z0-9]+"), 256


def _spots(part: pa.RecordBatch, word: re.Pattern, lexeme_of: Callable[[str], str | None]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """chunk_id and lexeme of each lexeme in each text of part, the border of its places (one more than there are lexemes) and all places in that order."""
    found = [word.findall(t or "") for t in part.column("text").to_pylist()]
    lexemes = pa.array([lexeme_of(w) for f in found for w in f], pa.string()).dictionary_encode()
    sizes = np.array([len(f) for f in found], np.int64)
    of = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    code = pc.fill_null(lexemes.indices, -1).to_numpy()
    order = np.lexsort((code, of))  # places stay in order
    order = order[code[order] >= 0]
    code, of, place = code[order], of[order], place[order]
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    return part.column("chunk_id").take(pa.array(of[new])), lexemes.dictionary.take(pa.array(code[new])), np.append(new, len(of)), place


def counted_terms(chunks: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """postings() of each row of chunks by itself, so rows of one id are not added up. wanted: lexemes besides which none are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexeme_of = (lambda w: w) if wanted is None else (lambda w: w if w in wanted else None)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                ids, lexemes, borders, _ = _spots(batch.slice(at, TEXTS), _TERM, lexeme_of)
                yield pa.RecordBatch.from_arrays([ids, lexemes, pa.array(np.diff(borders))], ["chunk_id", "lexeme", "tf"])

    schema = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("lexeme", T.StringType()), T.StructField("tf", T.LongType())])
    return chunks.select("chunk_id", F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(run, schema)


def lexical(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Chunks that have all terms of a query, by the mass of its terms: equi-joins on lexemes, no pairs of texts.

    A text's words are counted where it is read, and only texts of repeated ids are added up. The rarest term
    of a query names its candidates, so its frequent ones meet those alone. See operators.index for many
    searches of the same chunks.
    """
    from docloom.operators.store import new_folder

    wanted = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("t")).select("query_id", F.size("t").alias("need"), F.explode("t").alias("lexeme"))
    lexemes = wanted.select("lexeme").distinct()
    few = lexemes.count() <= BROADCAST_LEXEMES
    path = new_folder(chunks.sparkSession, "postings")
    counted_terms(chunks, frozenset(r[0] for r in lexemes.collect()) if few else None).write.option("compression", "zstd").parquet(path)  # BROADCAST_LEXEMES at most
    posts = chunks.sparkSession.read.parquet(path)
    again = chunks.groupBy("chunk_id").agg(F.count("*").alias("c")).where("c > 1").select("chunk_id")
    if not again.isEmpty():
        posts = posts.join(again, "chunk_id", "left_anti").unionByName(posts.join(again, "chunk_id", "left_semi").groupBy("chunk_id", "lexeme").agg(F.sum("tf").alias("tf")))
    df = posts.groupBy("lexeme").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "lexeme").groupBy("query_id", "need").agg(F.count("*").alias("known"), F.min_by("lexeme", F.struct("df", "lexeme")).alias("lexeme")).where("known = need").drop("known")
    candidates = posts.select("chunk_id", "lexeme").join(F.broadcast(rarest) if few else rarest, "lexeme").drop("lexeme")
    parts, rows = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.sparkSession.read.parquet(path).count()
    if rows > parts * PART_POSTINGS:  # so that what a task sorts does not grow with the corpus
        posts = posts.repartition(-(-rows // PART_POSTINGS), "chunk_id", "lexeme")
    hits = candidates.join(wanted.drop("need"), "query_id").join(posts, ["chunk_id", "lexeme"]).groupBy("query_id", "chunk_id", "need").agg(F.count("*").alias("have"), F.sum("tf").alias("mass"))
    return ranked(hits.where("have = need").select("query_id", "chunk_id", F.round(F.lit(0.1) * F.col("mass"), 6).alias("score")), k)


def hybrid(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties in the order of the first list, then the second."""
    both = first.select("query_id", "chunk_id", "rank", F.lit(0).alias("src")).unionByName(second.select("query_id", "chunk_id", "rank", F.lit(1).alias("src")))
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.col("src") * 1_000_000 + F.col("rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("seen")


def rerank(found: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10, scorer=None) -> DataFrame:
    """found scored anew, by the words of the query that a chunk has or by scorer.score(query, text); ties keep their order."""
    texts = found.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    scored = texts.select("query_id", "chunk_id", F.col("rank").alias("was"), F.round(pair_score(scorer), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "was")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("was")


def pair_score(scorer=None) -> Column:
    if scorer is None:
        return overlap_score(F.col("query"), F.col("text"))
    scored = lambda q, t: pa.array([scorer.score(a or "", b or "") for a, b in zip(q.to_pylist(), t.to_pylist())], pa.float64())
    return F.arrow_udf(scored, "double")("query", "text")


STRATEGIES = ("dense", "lexical", "hybrid")


def search(strategy: str | None, queries: DataFrame, chunks: DataFrame, k: int = 10, reranked: bool = False, lexical=None, scorer=None) -> DataFrame:
    """One lazy plan for a strategy (default hybrid); reranking takes RERANK_POOL times k candidates. lexical: the English search unless another is given."""
    lexical = lexical or english
    strategy = strategy or "hybrid"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    pool = k * RERANK_POOL if reranked else k
    if strategy == "hybrid":
        found = hybrid(dense(queries, chunks, RRF_POOL * pool), lexical(queries, chunks, RRF_POOL * pool), pool)
    else:
        found = (dense if strategy == "dense" else lexical)(queries, chunks, pool)
    return rerank(found, queries, chunks, k, scorer) if reranked else found


#: Words whose lexemes a task remembers.
WORDS_KEPT = 1 << 18


class _Lexemes(dict):
    """The lexeme of each word met; None of stop words, and of those whose lexeme is not wanted."""

    def __init__(self, wanted: frozenset[str] | None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> str | None:
        from docloom.functions.english import STOP_WORDS, stem

        if len(self) >= WORDS_KEPT:
            self.clear()
        lexeme = None if word in STOP_WORDS else stem(word)
        self[word] = found = lexeme if self.wanted is None or lexeme in self.wanted else None
        return found


def english_postings(chunks: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """chunk_id, lexeme and its positions, by the English analyser. Null texts have none. wanted: lexemes besides which none are given."""
    from docloom.functions.english import WORDS

    kind = chunks.schema["chunk_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexeme_of = _Lexemes(wanted)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                part = pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.array([(t or "").lower() for t in part.column("text").to_pylist()], pa.string())], ["chunk_id", "text"])
                ids, lexemes, borders, place = _spots(part, WORDS, lexeme_of.__getitem__)
                yield pa.RecordBatch.from_arrays([ids, lexemes, pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(place, pa.int32()))], ["chunk_id", "lexeme", "positions"])

    schema = T.StructType([T.StructField("chunk_id", kind), T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return chunks.select("chunk_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def english(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k best chunks of each query (with phrases, OR and exclusions) by cover density, stemmed and without stop words.

    Words that no query has are left out before any are written. The rarest lexeme that an alternative wants
    names its candidates, which are kept if they have all that it wants; queries of exclusions alone are held
    against every chunk. Queries without lexemes find nothing.
    """
    from docloom.functions.english import cover_density, matches, parse_query, parsed
    from docloom.operators.store import new_folder

    def needs(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            parts = parse_query(x or "")
            rows.append([{"alternative": i, "lexemes": sorted({t for want, term in c if want for t, _ in term}), "all": sorted({t for _, term in c for t, _ in term})} for i, c in enumerate(parts)])
        return pa.array(rows, pa.list_(pa.struct([("alternative", pa.int32()), ("lexemes", pa.list_(pa.string())), ("all", pa.list_(pa.string()))])))

    def scored(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for x, f in zip(texts.to_pylist(), found.to_pylist()):
            query, places = parsed(x or ""), {r["lexeme"]: r["positions"] for r in f or ()}
            out.append(cover_density(query, places) if matches(query, places) else None)
        return pa.array(out, pa.float64())

    asked = queries.select("query_id", F.col("query").cast("string").alias("query"))
    asked = asked.withColumn("a", F.explode(F.arrow_udf(needs, "array<struct<alternative: int, lexemes: array<string>, all: array<string>>>")("query"))).select("query_id", "query", "a.*")
    lexemes = asked.select(F.explode("all").alias("lexeme")).distinct()
    wanted = frozenset(r[0] for r in lexemes.collect()) if lexemes.count() <= BROADCAST_LEXEMES else None  # BROADCAST_LEXEMES at most
    posts = english_postings(chunks, wanted)
    path = new_folder(chunks.sparkSession, "english")
    (posts.join(lexemes, "lexeme", "left_semi") if wanted is None else posts).write.option("compression", "zstd").parquet(path)
    posts = chunks.sparkSession.read.schema(posts.schema).parquet(path)
    wants = asked.where(F.size("lexemes") > 0).select("query_id", "alternative", F.size("lexemes").alias("need"), F.explode("lexemes").alias("lexeme"))
    df = posts.groupBy("lexeme").agg(F.count("*").alias("df"))
    rarest = wants.join(df, "lexeme").groupBy("query_id", "alternative", "need").agg(F.count("*").alias("known"), F.min_by("lexeme", F.struct("df", "lexeme")).alias("lexeme")).where("known = need").drop("known")
    few = asked.count() <= BROADCAST_LEXEMES
    named = posts.select("chunk_id", "lexeme").join(F.broadcast(rarest) if few else rarest, "lexeme").drop("lexeme")
    held = named.join(wants.drop("need"), ["query_id", "alternative"]).join(posts.select("chunk_id", "lexeme"), ["chunk_id", "lexeme"])
    some = held.groupBy("query_id", "chunk_id", "alternative", "need").agg(F.count("*").alias("have")).where("have = need").select("query_id", "chunk_id")
    every = asked.where(F.size("lexemes") == 0)
    some = some.unionByName(every.select("query_id").distinct().crossJoin(chunks.select("chunk_id"))).distinct()
    lexemes = asked.select("query_id", F.explode("all").alias("lexeme")).distinct()
    places = some.join(lexemes, "query_id").join(posts, ["chunk_id", "lexeme"], "left").groupBy("query_id", "chunk_id").agg(F.collect_list(F.when(F.col("positions").isNotNull(), F.struct("lexeme", "positions"))).alias("found"))
    rated = places.join(asked.select("query_id", "query").distinct(), "query_id").select("query_id", "chunk_id", F.arrow_udf(scored, "double")("query", "found").alias("score"))
    return ranked(rated.where("score IS NOT NULL").withColumn("score", F.round("score", 6)), k)


def with_payload(found: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("document_id", "source_document", "text", "page", "section_path", "char_start", "char_end", "from_table")) -> DataFrame:
    """found with what chunks tell of each hit, joined after the k best are known; a null section path is an empty one."""
    kept = [c for c in columns if c in chunks.columns]
    joined = found.join(chunks.select("chunk_id", *kept), "chunk_id")
    if "section_path" in kept:
        joined = joined.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>")))
    return joined.select("query_id", "chunk_id", *kept, "score", "rank")
