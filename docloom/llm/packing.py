"""Packing documents into fixed-length sequences by column generation (operator 3).

Each document's ids are cut into full sequences, one piece of a multiple of GRID and a tail shorter
than GRID, so pieces have few distinct lengths at any corpus size. The cutting-stock linear program
over the histogram of lengths is solved on the driver by column generation: a knapsack dynamic
program prices new patterns with the duals. Rounded-down patterns take pieces by their rank among
those of equal length; what rounding leaves is packed greedily. Ranks come from counts by (length,
hash bucket), so no task ranks all pieces of one length.

Every id lies in exactly one piece. Only the last few sequences and slack of patterns are padded.

Defined results: null text counts as empty, which is the end id alone. Repeated rows are packed
each. Equal lengths are ranked by bucket, key and start. An empty table gives an empty result;
only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import bpe
from docloom.llm._shared import small_batches, written

CAPACITY = 4096
GRID = 64
END_ID = 2
#: Hash buckets in which pieces of one length are ranked.
BUCKETS = 1024
#: What demands are raised by, each by a different multiple, so that no two pivots meet the same vertex.
TILT = 1e-7


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(i, CAPACITY) for i in range(0, n - CAPACITY + 1, CAPACITY)]
    at = len(out) * CAPACITY
    for size in ((n - at) // GRID * GRID, (n - at) % GRID):
        if size:
            out.append((at, size))
            at += size
    return out


def _pieces_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, of = [], []
            for i, (ids, _) in enumerate(bpe.loaded(path, True).encode_texts([x or "" for x in batch.column("text").to_pylist()], show=False)):
                ids += end
                pieces = cut(len(ids) // 4)
                rows += [(a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), len(ids) // 4) for a, n in pieces]
                of += [i] * len(pieces)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of, pa.int64())), *columns], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length, together at most capacity, of the greatest total value."""
    best, stages = np.zeros(capacity + 1), []
    for value, length in zip(values, lengths):
        if value > 0:
            rows = -(-(capacity + 1) // length)
            grid = np.full(rows * length, -np.inf)
            grid[: capacity + 1] = best
            step = np.arange(rows)[:, None] * value
            best = (np.maximum.accumulate(grid.reshape(rows, length) - step, axis=0) + step).ravel()[: capacity + 1]
        stages.append(best)
    counts, c = np.zeros(len(lengths), np.int64), capacity
    for i in range(len(lengths) - 1, -1, -1):
        below = stages[i - 1] if i else np.zeros(capacity + 1)
        while c >= lengths[i] and stages[i][c] > below[c] + 1e-12:
            counts[i] += 1
            c -= lengths[i]
    return counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each, at its optimum.

    It ends when no pattern prices in, or when as many pivots as there are lengths have not lowered the
    number of sequences, which only rounding can bring about.
    """
    basis = np.diag((capacity // lengths).astype(float))
    use = demand * (1 + TILT * np.arange(1, len(demand) + 1) / len(demand)) / np.diag(basis)
    best, idle = np.inf, 0
    while idle <= len(lengths):
        duals = np.linalg.solve(basis.T, np.ones(len(lengths)))
        pattern = knapsack(duals, lengths, capacity).astype(float)
        if duals @ pattern <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern)
        able = np.flatnonzero(direction > 1e-9)
        ratio = np.maximum(use[able], 0) / direction[able]
        out = able[np.argmin(ratio)]
        amount = ratio.min()
        use = use - amount * direction
        use[out] = amount
        basis[:, out] = pattern
        best, idle = (use.sum(), 0) if use.sum() < best * (1 - 1e-12) else (best, idle + 1)
    return basis.astype(np.int64), use


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): pieces of each length in one sequence, and in how many; together all pieces."""
    left = dict(counts)
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: int) -> None:
        times = min([most, *(left[n] // k for n, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times

    if left.get(capacity):
        take({capacity: 1}, left[capacity])
    lengths = np.array(sorted((n for n in left if n < capacity), reverse=True), np.int64)
    if len(lengths):
        patterns, use = column_generation(lengths, np.array([left[int(n)] for n in lengths], float), capacity)
        for j in np.argsort(-use, kind="stable"):
            take({int(n): int(k) for n, k in zip(lengths, patterns[:, j]) if k}, int(use[j] + 1e-9))
    while any(left.values()):  # at most a sequence or so for each pattern
        pattern, room = {}, capacity
        for n in sorted(left, reverse=True):
            if k := min(left[n], room // n):
                pattern[n] = k
                room -= k * n
        take(pattern, 1 << 62)
    return out


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces_of(path or bpe.default_path()), f"key {docs.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = written(pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "start"), F.lit(BUCKETS))), "pieces")
    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("c")), "piece-counts")
    total = {n: c for n, c in counts.groupBy("length").agg(F.sum("c")).collect()}  # at most 2 * GRID lengths
    slots, used, first = [], dict.fromkeys(total, 0), 0
    for pattern, times in plan(total):
        offset = 0
        for n, k in pattern.items():
            slots.append((n, used[n], used[n] + k * times, k, first, offset))
            used[n] += k * times
            offset += n * k
        first += times
    table = spark.createDataFrame(slots, "length long, lo long, hi long, each long, first long, base long")  # at most GRID * 2 lengths in each of as many patterns
    before = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "start")) - 1
    ranked = pieces.withColumn("inner", inner.cast("long")).join(F.broadcast(starts), ["length", "bucket"])  # at most 2 * GRID * BUCKETS rows
    ranked = ranked.withColumn("rank", F.col("inner") + F.col("before")).alias("r")
    slot = F.broadcast(table).alias("s")
    placed = ranked.join(slot, (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        F.col("key").alias(key), "start", "r.length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("r.length")).alias("offset"),
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
