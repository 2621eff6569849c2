"""A stored inverted index with block-max pruning, kept up as chunks come and go.

A block holds the postings of one lexeme in one window of SPAN chunk ids: the ids' distances, the number
of places in each, and the greatest of these numbers, the block's bound. Blocks lie in BUCKETS folders by
the lexeme's hash, sorted, so a search reads the folders and row groups of its own lexemes. As all lexemes
share the windows, blocks meet by equality: a window in which a lexeme of the query has no block
drops out, and the sum of its blocks' bounds is what a chunk there can reach at most. A search scores the
WAVE windows of greatest bound of each query first and takes the k-th best mass there as the limit;
of the other windows it reads those alone whose bound reaches the limit, so no hit is lost.

Defined results: the same rows as retrieval.lexical over the chunks that were added and not removed.
Null texts have no lexemes; queries without any find nothing. Chunk ids are whole numbers; null ids
are left aside. An id must be added once; one that was removed stays so. An empty index finds nothing.
Repeated query ids count as one query with the lexemes of all. Further columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.retrieval import BROADCAST_LEXEMES, ranked, terms

SPAN, BUCKETS, WAVE = 4096, 64, 4
#: Characters of text that a task cuts into blocks at once; files of a folder that one addition makes at most.
PART_BYTES, FILES = 1 << 22, 8

BLOCKS = "bucket int, lexeme string, win long, n int, most long, steps binary, counts binary"
REMOVED = "chunk_id long"


def bucket(lexeme) -> F.Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def _cut(lexemes: pa.Array, ids: np.ndarray, counts: np.ndarray, span: int) -> list[pa.Array]:
    """lexeme, win, n, most, steps and counts of the blocks of postings, which are sorted by lexeme (dictionary-encoded) and id."""
    code, win = lexemes.indices.to_numpy(), np.floor_divide(ids, span)
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(win, prepend=win[:1] - 1) != 0))
    ends = np.append(new[1:], len(ids))
    steps = np.diff(ids - win * span, prepend=0)
    steps[new] = (ids - win * span)[new]
    most = np.maximum.reduceat(counts, new) if len(new) else counts
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(new.tolist(), ends.tolist())], pa.binary()) for x in (steps.astype(np.uint16), counts.astype(np.uint32))]
    return [lexemes.dictionary.take(pa.array(code[new])).cast(pa.string()), pa.array(win[new]), pa.array((ends - new).astype(np.int32)), pa.array(most.astype(np.int64)), *packed]


def _part(ids: list[int], texts: list[str], span: int) -> pa.RecordBatch:
    """The blocks of some chunks."""
    found = [_WORD.findall(t) for t in texts]
    words = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    of = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
    order = np.lexsort((of, words.indices.to_numpy()))
    code, of = words.indices.to_numpy()[order], of[order]
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=of[:1] - 1) != 0))
    counts = np.diff(np.append(new, len(of)))
    return pa.RecordBatch.from_arrays(_cut(pa.DictionaryArray.from_arrays(pa.array(code[new]), words.dictionary), of[new], counts, span), _PART)


_WORD = re.compile("[a-z0-9]+")
_PART = ["lexeme", "win", "n", "most", "steps", "counts"]


def blocks(chunks: DataFrame) -> DataFrame:
    """BLOCKS of chunks (chunk_id, text). Tasks cut the postings of PART_BYTES of text into blocks; those of one lexeme and window, SPAN at most, are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "text"))):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= PART_BYTES:
                    yield _part(ids, texts, SPAN)
                    ids, texts, size = [], [], 0
        if texts:
            yield _part(ids, texts, SPAN)

    rows = chunks.where("chunk_id IS NOT NULL AND text IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(F.col("text").cast("string")).alias("text"))
    parts = rows.mapInArrow(run, "lexeme string, win long, n int, most long, steps binary, counts binary")
    # dealt out once, as add() writes them; a lexeme's windows may lie in several files of its folder
    dealt = parts.withColumn("bucket", bucket(F.col("lexeme"))).withColumn("file", F.pmod(F.xxhash64("lexeme", "win"), F.lit(FILES))).repartition("bucket", "file")
    met = dealt.groupBy("bucket", "file", "lexeme", "win").agg(F.sum("n").cast("int").alias("n"), F.max("most").alias("most"), F.collect_list(F.struct("steps", "counts")).alias("p"))

    kept = ("bucket", "lexeme", "win", "n", "most")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("p")).to_numpy()
            # most lexemes stand in one part alone, whose block passes as it is
            alone, flat = sizes == 1, batch.column("p").flatten()
            single, first = batch.filter(pa.array(alone)), pa.array((np.cumsum(sizes) - sizes)[alone])
            yield pa.RecordBatch.from_arrays([*[single.column(c) for c in kept], *[flat.field(c).take(first) for c in ("steps", "counts")]], ["bucket", *_PART])
            several, steps, counts = batch.filter(pa.array(~alone)), [], []
            for p in several.column("p").to_pylist():
                at = np.concatenate([np.cumsum(np.frombuffer(x["steps"], np.uint16).astype(np.int64)) for x in p])
                order = np.argsort(at)
                steps.append(np.diff(at[order], prepend=0).astype(np.uint16).tobytes())
                counts.append(np.concatenate([np.frombuffer(x["counts"], np.uint32) for x in p])[order].tobytes())
            yield pa.RecordBatch.from_arrays([*[several.column(c) for c in kept], pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], ["bucket", *_PART])

    return met.mapInArrow(joined, "bucket int, lexeme string, win long, n int, most long, steps binary, counts binary")


def _met(rows: list[dict], need: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that all `need` lexemes of a window have, and their numbers of places together. rows: steps and counts of each block."""
    have, mass = np.zeros(span, np.int64), np.zeros(span, np.int64)
    for r in rows:
        at = np.cumsum(np.frombuffer(r["steps"], np.uint16).astype(np.int64))
        have[at] += 1
        mass[at] += np.frombuffer(r["counts"], np.uint32)
    at = np.flatnonzero(have == need)
    return at, mass[at]


class InvertedIndex:
    """Blocks and removed ids under one path, for one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if self._there("blocks-new/_SUCCESS") and not self._there("blocks"):  # compact() broke off between its two renames
            self._moved("blocks-new", "blocks")

    def _place(self, name: str):
        """The file system and the path of a folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _there(self, name: str) -> bool:
        files, where = self._place(name)
        return files.exists(where)

    def _moved(self, old: str, new: str) -> None:
        files, where = self._place(old)
        if not files.rename(where, self._place(new)[1]):
            raise OSError(f"{self.path}/{old} cannot be moved to {new}")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as wrong:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(wrong):
                raise
            return self.spark.createDataFrame([], schema)

    def blocks(self) -> DataFrame:
        return self._table("blocks", BLOCKS)

    def removed(self) -> DataFrame:
        return self._table("removed", REMOVED)

    def add(self, chunks: DataFrame) -> None:
        """Takes in chunks (chunk_id, text) with new ids. A run that breaks off leaves nothing behind, as its files are committed together."""
        made = blocks(chunks).sortWithinPartitions("bucket", "lexeme", "win")
        made.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/blocks")

    def remove(self, ids: DataFrame) -> None:
        """Chunks with an id (chunk_id) in ids are found no longer."""
        ids.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().write.mode("append").parquet(f"{self.path}/removed")

    def compact(self) -> None:
        """Writes the blocks anew without removed ids, several of one lexeme and window as one, and then puts the new folder in the old one's place."""
        kept = self.postings().join(self.removed().distinct(), "chunk_id", "left_anti").withColumn("bucket", bucket(F.col("lexeme")))
        ordered = kept.groupBy("bucket", "lexeme", F.expr(f"floor(chunk_id / {SPAN})").alias("win")).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "tf"))).alias("p"))  # at most SPAN

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    at, counts = np.array([x["chunk_id"] - r["win"] * SPAN for x in r["p"]]), np.array([x["tf"] for x in r["p"]])
                    rows.append((r["bucket"], r["lexeme"], r["win"], len(at), int(counts.max()), np.diff(at, prepend=0).astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes()))
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        made = ordered.mapInArrow(run, BLOCKS).repartitionByRange("bucket", "lexeme", "win").sortWithinPartitions("bucket", "lexeme", "win")
        made.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/blocks-new")
        self._moved("blocks", "blocks-old")
        self._moved("blocks-new", "blocks")
        for name in ("removed", "blocks-old"):
            files, where = self._place(name)
            files.delete(where, True)

    def postings(self) -> DataFrame:
        """chunk_id, lexeme and tf, as retrieval.postings gives them, read from the blocks; removed ids included."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                steps = [np.cumsum(np.frombuffer(x, np.uint16).astype(np.int64)) for x in batch.column("steps").to_pylist()]
                if not len(n):
                    continue
                ids = np.concatenate(steps) + np.repeat(batch.column("win").to_numpy() * SPAN, n)
                tf = np.concatenate([np.frombuffer(x, np.uint32) for x in batch.column("counts").to_pylist()]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("lexeme").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(tf)], ["chunk_id", "lexeme", "tf"])

        return self.blocks().select("lexeme", "win", "n", "steps", "counts").mapInArrow(run, "chunk_id long, lexeme string, tf long")

    def _of(self, wanted: DataFrame) -> DataFrame:
        """The blocks of the lexemes in wanted, with wanted's columns; only folders that can have some are read."""
        lexemes = wanted.select("lexeme").distinct()
        few = lexemes.count() <= BROADCAST_LEXEMES
        folders = [r[0] for r in lexemes.select(bucket(F.col("lexeme"))).distinct().collect()]  # BUCKETS at most
        found = self.blocks().where(F.col("bucket").isin(folders)).drop("bucket")
        return found.join(F.broadcast(wanted) if few else wanted, "lexeme")

    def windows(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lexemes of each query (query_id, need, lexeme), and its windows that have all of them, with what a chunk there can reach (query_id, need, win, bound)."""
        words = queries.select("query_id", F.explode(terms(F.col("query"))).alias("lexeme")).distinct()
        wanted = words.join(words.groupBy("query_id").agg(F.count("*").alias("need")), "query_id")
        each = self._of(wanted).groupBy("query_id", "need", "win", "lexeme").agg(F.max("most").alias("most"))
        return wanted, each.groupBy("query_id", "need", "win").agg(F.count("*").alias("have"), F.sum("most").alias("bound")).where("have = need").drop("have")

    def _scored(self, wanted: DataFrame, wins: DataFrame) -> DataFrame:
        """query_id, chunk_id and mass of the chunks in windows (query_id, need, win) that have all lexemes."""
        rows = self._of(wanted).join(wins.select("query_id", "win"), ["query_id", "win"])
        met = rows.groupBy("query_id", "win", "need").agg(F.collect_list(F.struct("steps", "counts")).alias("b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    at, mass = _met(batch.column("b")[i].as_py(), batch.column("need")[i].as_py(), SPAN)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(np.full(len(at), i))), pa.array(at + batch.column("win")[i].as_py() * SPAN), pa.array(mass)], ["query_id", "chunk_id", "mass"])

        kind = dict(wanted.dtypes)["query_id"]
        found = met.select("query_id", "win", "need", "b").mapInArrow(run, f"query_id {kind}, chunk_id long, mass long")
        return found.join(self.removed().distinct(), "chunk_id", "left_anti")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, chunk_id, score and rank of the k best chunks of each query (query_id, query) that have all of its lexemes."""
        from docloom.operators.store import _held

        wanted, wins = self.windows(queries)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "win")
        wins = _held(wins.withColumn("place", F.row_number().over(order)))
        first = _held(self._scored(wanted, wins.where(F.col("place") <= WAVE)))
        best = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mass"), "chunk_id"))).where(F.col("r") <= k)
        limit = best.where(F.col("r") == k).select("query_id", F.col("mass").alias("least"))
        rest = wins.where(F.col("place") > WAVE).join(limit, "query_id", "left").where("least IS NULL OR bound >= least")
        found = best.drop("r").unionByName(self._scored(wanted, rest))
        return ranked(found.select("query_id", "chunk_id", F.round(F.lit(0.1) * F.col("mass"), 6).alias("score")), k)
