"""A stored vector index: inverted lists with residual product codes, and an exact search by bounds on their error.

A fit on a bounded sample (SAMPLE_VALUES) makes centroids of lists and, for each STEP dimensions of what a
vector differs from its centroid, a book of up to 256 values. Every row is coded: its list, a byte for each
book, and the length of what the code leaves out. By the inequality of Cauchy and Schwarz a cosine is
within that length of what the codes say. So a search takes the k-th greatest lower bound in the WAVE lists
nearest to each query as the limit, leaves out lists that cannot reach it, and of the others keeps the rows
whose upper bound does; whole vectors are read for those alone, and scored as retrieval.dense scores them.

Defined results: search() gives the rows of retrieval.dense over the rows that were added and not removed;
with probes, at most that many lists are read for each query and some hits may be missing (see recall()).
Null, empty, zero and not finite vectors, and those of another length than the index's, find nothing and
are not found. Chunk ids are whole numbers; null ids are left aside. An id must be added once; one that was
removed stays so. Equal vectors tie by id. An index fitted on no vectors holds none. Further columns are
left aside.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.retrieval import _dot, _rounded, ranked

#: Values in the sample of the fit, and its rows at most; lists at most; dimensions of a book; rounds of k-means.
SAMPLE_VALUES, SAMPLE_ROWS, LISTS, STEP, ROUNDS = 1 << 23, 40_000, 64, 1, 8
#: Rows of a block; queries of a block; lists that give the first limit; folders.
ROWS, QUERY_ROWS, WAVE, FOLDERS = 4096, 256, 8, 16
#: What single precision may lose, and what rounding a score to six places may move.
SLACK = 2e-5
#: More candidate rows than this (some 50 bytes each) meet the vectors by shuffle instead of broadcast.
BROADCAST_CANDIDATES = 200_000

MODEL = "dim int, centroids binary, books binary"
VECTORS = "id long, list int, v binary, code binary, err float, same binary"
#: What blocks are made of.
NARROW = ["list", "id", "code", "err", "same"]
BLOCKS = "list int, n int, reach float, ids binary, codes binary, errs binary, copies binary, batch string"


def _usable(ids: pa.Array, lists: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors (doubles) of length dim, without those that have no direction. dim None: the commonest length."""
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()] if lists.null_count else np.diff(lists.offsets.to_numpy()))
    if dim is None:
        there = lengths[lengths > 0]
        dim = int(np.bincount(there).argmax()) if len(there) else 0
    take = pa.array(np.flatnonzero((lengths == dim) & (dim > 0)))
    v = lists.take(take).flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1)).astype(np.float64)
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return ids.take(take).to_numpy(zero_copy_only=False)[good], v[good]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if x.shape[1] == 1:
        order = np.argsort(c[:, 0], kind="stable")
        return order[np.searchsorted((c[order[1:], 0] + c[order[:-1], 0]) / 2, x[:, 0])]
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + ROWS] @ c.T - half, axis=1) for a in range(0, len(x), ROWS)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spread distinct rows; the same for the same rows in the same order."""
    first = np.unique(x, axis=0)
    c = first[np.linspace(0, len(first) - 1, min(k, len(first))).astype(np.int64)]
    for _ in range(ROUNDS):
        of = _nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        sums = np.stack([np.bincount(of, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _fit(ids: np.ndarray, v: np.ndarray, lists: int) -> tuple[int, bytes, bytes]:
    dim = v.shape[1] if len(v) else 0
    if not dim:
        return 0, b"", b""
    x = _unit(v)[np.argsort(ids, kind="stable")]
    c = _means(x, max(1, min(lists, len(x) // 16)))
    rest = x - c[_nearest(x, c)]
    books = np.zeros((-(-dim // STEP), 256, STEP))
    for b in range(len(books)):
        made = _means(np.pad(part := rest[:, b * STEP : (b + 1) * STEP], ((0, 0), (0, STEP - part.shape[1]))), 256)
        books[b, : len(made)] = made
        books[b, len(made) :] = made[0]
    return dim, c.astype(np.float32).tobytes(), books.astype(np.float32).tobytes()


class Model:
    """Centroids and books of a fit."""

    def __init__(self, dim: int, centroids: bytes, books: bytes):
        self.dim = dim
        self.centroids = np.frombuffer(centroids, np.float32).reshape(-1, max(dim, 1))
        self.books = np.frombuffer(books, np.float32).reshape(-1, 256, STEP)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """What codes say of the vectors' differences from their centroid."""
        parts = self.books[np.arange(len(self.books)), codes]
        return parts.reshape(len(codes), -1)[:, : self.dim]

    def coded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and the length of what the code leaves out, for each vector."""
        x = _unit(v)
        of = _nearest(x, self.centroids)
        rest = np.pad(x - self.centroids[of], ((0, 0), (0, len(self.books) * STEP - self.dim)))
        codes = np.stack([_nearest(rest[:, b * STEP : (b + 1) * STEP], book) for b, book in enumerate(self.books)], axis=1).astype(np.uint8)
        return of, codes, np.linalg.norm(rest[:, : self.dim] - self.decoded(codes), axis=1)


def _blocks_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ROWS rows (batch and NARROW) that come sorted by list and batch."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def block(of: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).sort_by("id")
        _, place = np.unique(np.array(t.column("same").to_pylist(), object).astype("S16"), return_inverse=True)
        order = np.argsort(place, kind="stable")
        start = np.flatnonzero(np.diff(place[order], prepend=-1))
        copies = np.empty(len(order), np.int32)
        copies[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        codes = b"".join(t.column("code").to_pylist())
        errs = t.column("err").to_numpy()
        reach = np.linalg.norm(model.decoded(np.frombuffer(codes, np.uint8).reshape(len(t), -1)), axis=1) + errs
        made = (of, len(t), float(reach.max()), t.column("id").to_numpy().tobytes(), codes, errs.tobytes(), copies.tobytes(), t.column("batch")[0].as_py())
        kinds = (pa.int32(), pa.int32(), pa.float32(), *[pa.binary()] * 4, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, kinds)], names)

    held, size, at = [], 0, None
    for batch in batches:
        keys = list(zip(batch.column("list").to_pylist(), batch.column("batch").to_pylist()))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
        for a, b in zip(edges, edges[1:]):
            if held and at != keys[a]:
                yield block(at[0], held)
                held, size = [], 0
            at = keys[a]
            while a < b:
                part = batch.slice(a, min(b - a, ROWS - size))
                held.append(part)
                size, a = size + part.num_rows, a + part.num_rows
                if size == ROWS:
                    yield block(at[0], held)
                    held, size = [], 0
    if held:
        yield block(at[0], held)


class VectorIndex:
    """Model, coded vectors, blocks of codes and removed ids under one path, for one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as wrong:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(wrong):
                raise
            return self.spark.createDataFrame([], schema)

    def fit(self, chunks: DataFrame, lists: int = LISTS) -> None:
        """Fits lists and books on a sample of chunks (chunk_id, embedding): the SAMPLE_ROWS of smallest hash, of SAMPLE_VALUES values together."""
        rows = chunks.where("chunk_id IS NOT NULL AND size(embedding) > 0").select(F.col("chunk_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, left, dim = [], [], SAMPLE_VALUES, None
            for batch in batches:
                i, v = _usable(batch.column("id"), batch.column("v"), dim)
                dim = v.shape[1] if len(v) else dim
                most = max(0, left // max(v.shape[1], 1))
                ids.append(i[:most])
                vectors.append(v[:most])
                left -= vectors[-1].size
            vectors = [v for v in vectors if len(v)]
            made = _fit(np.concatenate(ids), np.concatenate(vectors), lists) if vectors else (0, b"", b"")
            yield pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, (pa.int32(), pa.binary(), pa.binary()))], ["dim", "centroids", "books"])

        sample.coalesce(1).mapInArrow(run, MODEL).write.mode("overwrite").parquet(f"{self.path}/model")

    def model(self) -> Model:
        """LISTS centroids and 256 values for each dimension at most, in single precision."""
        rows = self._table("model", MODEL).take(1)
        if not rows:
            raise ValueError("the index has no model yet: call fit() first")
        return Model(rows[0]["dim"], bytes(rows[0]["centroids"]), bytes(rows[0]["books"]))

    def add(self, chunks: DataFrame) -> None:
        """Takes in chunks (chunk_id, embedding) with new ids. A run that breaks off leaves vectors that no block names, and so nothing to find."""
        model, batch_name = self.model(), uuid.uuid4().hex

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v = _usable(batch.column("id"), batch.column("v"), model.dim)
                if len(ids):
                    of, codes, err = model.coded(v)
                    raw = [x.tobytes() for x in v]
                    same = [hashlib.blake2b(x, digest_size=15).digest() + b"\1" for x in raw]
                    arrays = [pa.array(ids, pa.int64()), pa.array(of, pa.int32()), pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.nextafter(err.astype(np.float32), np.float32(9))), pa.array(same, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in VECTORS.split(", ")])

        rows = chunks.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("chunk_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        place = f"{self.path}/vectors/batch={batch_name}"
        rows.mapInArrow(code, VECTORS).write.option("compression", "zstd").parquet(place)
        self._write(self.spark.read.schema(VECTORS).parquet(place).withColumn("batch", F.lit(batch_name)), model, self._generation())

    def remove(self, ids: DataFrame) -> None:
        """Chunks with an id (chunk_id) in ids are found no longer: the blocks are made anew from the other rows' codes. If it breaks off, the old blocks count, and it can be repeated."""
        model, now = self.model(), self._generation()
        ids.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("id")).distinct().write.mode("append").parquet(f"{self.path}/removed")
        batches = self._blocks().select("batch").distinct()  # as many as there were additions
        rows = self._table("vectors", f"{VECTORS}, batch string").select("batch", *NARROW).join(F.broadcast(batches), "batch", "left_semi")
        self._write(rows.join(self._table("removed", "id long").distinct(), "id", "left_anti"), model, now + 1)
        files, where = self._place(f"blocks-{now}")
        files.delete(where, True)

    def _place(self, name: str):
        """The file system and the path of a folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _generation(self) -> int:
        """Of the blocks that were written whole the newest."""
        files, where = self._place("")
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        numbers = [int(n.removeprefix("blocks-")) for n in names if n.startswith("blocks-")]
        return max((n for n in numbers if files.exists(self._place(f"blocks-{n}/_SUCCESS")[1])), default=0)

    def _blocks(self) -> DataFrame:
        return self._table(f"blocks-{self._generation()}", f"{BLOCKS}, folder int").drop("folder")

    def _write(self, rows: DataFrame, model: Model, generation: int) -> None:
        """Appends blocks of rows (batch and NARROW)."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _blocks_of(batches, model)

        # a rebalance, unlike a repartition by list, lets Spark split a list that holds a third of all rows
        blocks = rows.select("batch", *NARROW).hint("rebalance", "list").sortWithinPartitions("list", "batch").mapInArrow(cut, BLOCKS)
        blocks.withColumn("folder", F.col("list") % FOLDERS).write.mode("append").partitionBy("folder").option("compression", "zstd").parquet(f"{self.path}/blocks-{generation}")

    def _asked(self, queries: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
        """Query ids with the digest of their vector (query_id, same), and each vector once (same, q)."""
        from docloom.operators.store import _held

        kind = dict(queries.dtypes)["query_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, v = _usable(pa.array(np.arange(batch.num_rows)), batch.column("v"), model.dim)
                if len(at):
                    raw = [x.tobytes() for x in v]
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["query_id", "same", "q"])

        rows = _held(queries.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(run, f"query_id {kind}, same binary, q binary"))
        return rows.select("query_id", "same"), _held(rows.groupBy("same").agg(F.first("q").alias("q")))

    def _visits(self, asked: DataFrame, model: Model, reach: dict[int, float], lo: int, hi: int) -> DataFrame:
        """Blocks of up to QUERY_ROWS vectors of asked (same, q, least) for each list from place lo to hi in a query's order that can reach its limit."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = np.array([reach.get(i, -9.0) for i in range(len(model.centroids))])
            for batch in batches:
                for a in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(a, QUERY_ROWS)
                    q = _unit(np.frombuffer(b"".join(part.column("q").to_pylist()), np.float64).reshape(-1, model.dim)).astype(np.float32)
                    near, least = q @ model.centroids.T, part.column("least").to_numpy()
                    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                    visit = (place >= lo) & (place < hi) & (near + far + SLACK >= least[:, None]) & (far > -9)
                    for of in np.flatnonzero(visit.any(axis=0)).tolist():
                        rows = np.flatnonzero(visit[:, of])
                        made = (of, b"".join(part.column("same").take(pa.array(rows)).to_pylist()), q[rows].tobytes(), least[rows].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, (pa.int32(), *[pa.binary()] * 3))], ["list", "sames", "qs", "leasts"])

        return asked.mapInArrow(spread, "list int, sames binary, qs binary, leasts binary")

    def _bounded(self, visits: DataFrame, model: Model, k: int, blocks: DataFrame) -> DataFrame:
        """same, id, batch and the bounds low and high of the rows of the visited lists that reach the limits, those of a block's own k best included."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                    q, least = np.frombuffer(get("qs"), np.float32).reshape(-1, model.dim), np.frombuffer(get("leasts"), np.float64)
                    n, ids, errs = get("n"), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("errs"), np.float32)
                    # of equal vectors the k smallest ids are ahead of all others
                    keep = np.flatnonzero(np.frombuffer(get("copies"), np.int32) < k)
                    x = model.centroids[get("list")] + model.decoded(np.frombuffer(get("codes"), np.uint8).reshape(n, -1)[keep])
                    near, err = q @ x.T, errs[keep]
                    low = near - err
                    own = np.partition(low, len(keep) - k, axis=1)[:, len(keep) - k] if len(keep) >= k else np.full(len(q), -9.0)
                    i, j = np.nonzero(near + err + SLACK >= np.maximum(own, least)[:, None])
                    sames = np.array([get("sames")[a : a + 16] for a in range(0, 16 * len(q), 16)], object)
                    yield pa.RecordBatch.from_arrays([pa.array(sames[i], pa.binary()), pa.array(ids[keep[j]]), pa.array([get("batch")] * len(i), pa.string()), pa.array(low[i, j].astype(np.float64)), pa.array((near + err)[i, j].astype(np.float64))], ["same", "id", "batch", "low", "high"])

        met = visits.join(blocks, "list").select("list", "sames", "qs", "leasts", "n", "ids", "codes", "errs", "copies", "batch")
        return met.mapInArrow(run, "same binary, id long, batch string, low double, high double")

    @staticmethod
    def _limits(bounded: DataFrame, k: int) -> DataFrame:
        """same and the k-th greatest lower bound, where there are k."""
        order = Window.partitionBy("same").orderBy(F.desc("low"))
        return bounded.select("same", "low").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).select("same", F.col("low").alias("limit"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, score and rank of the k vectors of greatest cosine to each query (query_id, query_embedding); probes: lists read for each at most."""
        from docloom.operators.store import _held

        model = self.model()
        found = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id long, score double, rank long"
        if not model.dim:
            return self.spark.createDataFrame([], found)
        ids, asked = self._asked(queries, model)
        blocks = self._blocks()
        reach = {r["list"]: r["reach"] for r in blocks.groupBy("list").agg(F.max("reach").alias("reach")).collect()}  # LISTS at most
        most = len(model.centroids) if probes is None else min(probes, len(model.centroids))
        wave = min(WAVE, most)
        first = _held(self._bounded(self._visits(asked.withColumn("least", F.lit(-9.0)), model, reach, 0, wave), model, k, blocks))
        limited = asked.join(self._limits(first, k), "same", "left").select("same", "q", F.coalesce("limit", F.lit(-9.0)).alias("least"))
        rest = self._bounded(self._visits(limited, model, reach, wave, most), model, k, blocks)
        every = _held(first.unionByName(rest))
        near = every.join(self._limits(every, k), "same", "left").where(F.col("limit").isNull() | (F.col("high") + SLACK >= F.col("limit"))).select("same", "id", "batch")
        near = _held(near)
        few = near.count() <= BROADCAST_CANDIDATES
        vectors = self._table("vectors", f"{VECTORS}, batch string").select("id", "batch", "v")
        pairs = vectors.join(F.broadcast(near) if few else near, ["id", "batch"]).join(asked, "same").select("same", "id", "q", "v")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, c = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.float64).reshape(-1, model.dim) for x in ("q", "v"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    norm = np.sqrt(_dot(c, c)) * np.sqrt(_dot(q, q))
                    score = _dot(c, q) / norm
                good = norm > 0
                yield pa.RecordBatch.from_arrays([batch.column("same").filter(pa.array(good)), batch.column("id").filter(pa.array(good)), pa.array(_rounded(score[good]))], ["query_id", "chunk_id", "score"])

        best = ranked(pairs.mapInArrow(exact, "query_id binary, chunk_id long, score double"), k)
        return ids.join(best.withColumnRenamed("query_id", "same"), "same").select("query_id", "chunk_id", "score", "rank")

def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query of exact (query_id, chunk_id, rank) the number of its hits, and of those that found has too."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
