"""Exact deduplication by deterministic block naming (operator 5).

Texts are normalised and cut into blocks of BLOCK code points. All blocks are sorted over the
cluster, by a hash and then by their own code points, and named by rank: equal blocks, and only
those, get the same integer. Then adjacent names of a text are paired, and the pairs sorted and named
in turn, until each text has one name; texts of the same number of rounds and the same name are
equal, with no chance of collision. The sort is by range of (hash, row), so copies of one block,
however many, spread over several tasks; each task names its own runs, and the driver only adds up
how many names each task used. Blocks of one hash that differ get names of their own.

Defined results: null text counts as empty; all empty texts are one group. Of equal texts the row
with the smallest key stays, of equal keys the first row read; null keys come last. An empty table
gives an empty result. Other columns of the input are not read. keep_exact tells rows apart by their
place in the input: rows of one key with different texts all stay, and of rows that repeat a key and a
text one does. Names of columns may clash with those used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm._shared import numbered, partitions, small_batches, written

BLOCK = 1024


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _edge(columns: list[pa.Array], i: int) -> bytes:
    return "\x1f".join(str(c[i].as_py()) for c in columns).encode()


def _starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row differs from the one before it; the first row is left for the caller."""
    out = np.zeros(n, bool)
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _name_runs(lead: list[str], keys: list[str], carried: list[str], schema: pa.Schema):
    """Within a partition sorted by lead and keys: the rank of each row's run; then, as rows of their own, the runs that its first (_at 0) and its last (_at 1) lead has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, last_key, last_lead, only = TaskContext.get().partitionId(), 0, None, None, True
        edges: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        leads = [b"", b""]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of_lead, of_key = ([batch.column(c) for c in x] for x in (lead, keys))
            turn, fresh = _starts(of_lead, n), _starts(of_key, n)
            turn[0], fresh[0] = last_lead is not None and _edge(of_lead, 0) != last_lead, _edge(of_key, 0) != last_key
            if last_lead is None:
                leads[0] = leads[1] = _edge(of_lead, 0)
            local = names + np.cumsum(fresh)
            turns, runs = np.flatnonzero(turn), np.flatnonzero(fresh)
            if only:
                edges[0].update((_edge(of_key, int(i)), int(local[i])) for i in runs[runs < (turns[0] if len(turns) else n)])
                only = not len(turns)
            if len(turns):
                edges[1].clear()
                leads[1] = _edge(of_lead, int(turns[-1]))
            edges[1].update((_edge(of_key, int(i)), int(local[i])) for i in runs[runs >= (turns[-1] if len(turns) else 0)])
            names, last_key, last_lead = int(local[-1]), _edge(of_key, n - 1), leads[1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(local), pa.array(np.full(n, part)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
        for at in (0, 1):
            n = len(edges[at])
            if n:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, schema.field(c).type) for c in carried], pa.array(list(edges[at].values()), pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, at)), pa.array([leads[at]] * n, pa.binary()), pa.array(list(edges[at]), pa.binary())], schema=schema)

    return run


def _offsets(edges: list[tuple[int, int, bytes, int, int]]) -> list[tuple[int, int, list[int]]]:
    """Of (part, at, lead, key, local name) of the edges: for each partition what its names are raised by, and the names of the runs of its first lead."""
    parts: dict[int, tuple[dict, dict]] = {}
    for part, at, lead, key, local in edges:
        parts.setdefault(part, ({}, {}))[at][lead, key] = local
    out, used, before = [], 0, {}
    for part in sorted(parts):
        first, last = parts[part]
        names, offset = {}, used
        for key, local in sorted(first.items(), key=lambda x: x[1]):
            if key in before:
                offset -= 1
            names[key] = before.get(key, local + offset)
        out.append((part, offset, list(names.values())))
        used = offset + max(last.values())
        same_lead = {lead for lead, _ in last}
        before = {key: name for key, name in before.items() if key[0] in same_lead} | {key: names.get(key, local + offset) for key, local in last.items()}
    return out


def named(df: DataFrame, lead: list[str], keys: list[str], carried: list[str], tie: list[str]) -> DataFrame:
    """carried and `name`: 1, 2, ... over the distinct non-null keys in the order of lead and keys, the same for the same keys.

    lead depends on the keys alone. Ranges are drawn over lead and tie, so no key goes to the driver as a
    sample; keys of one lead that a border of ranges parts are told apart on the cluster.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    own = [T.StructField("name", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_lead", T.BinaryType()), T.StructField("_key", T.BinaryType())]
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carried] + own)
    ordered = df.repartitionByRange(partitions(spark), *lead, *tie).sortWithinPartitions(*dict.fromkeys([*lead, *keys]))
    runs = written(ordered.mapInArrow(_name_runs(lead, keys, carried, to_arrow_schema(out)), out), "names")
    place = F.dense_rank().over(Window.partitionBy("_lead").orderBy("_key"))
    edges = runs.where("_at IS NOT NULL").select("_part", "_at", "_lead", place.alias("key"), "name")  # two rows for each partition, but for equal leads of other keys
    table = spark.createDataFrame(_offsets([tuple(r) for r in edges.collect()]), "_part long, _offset long, _names array<long>")
    rows = runs.where("_at IS NULL").join(F.broadcast(table), "_part")
    name = F.when(F.col("name") <= F.size("_names"), F.get("_names", (F.col("name") - 1).cast("int"))).otherwise(F.col("name") + F.col("_offset"))
    return rows.select(*carried, name.alias("name"))


def identities(docs: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """row (the column row, else a number of each input row), key, sha256 of the normalised text, and its identity (rounds, name)."""
    small_batches(docs.sparkSession)
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    texts = docs.select(number.alias("row"), F.col(f"`{key}`").alias("key"), normalised(F.col(f"`{text}`")).alias("t"))
    cut = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    texts = texts.select("row", "key", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), F.when(F.length("t") == 0, F.array(F.lit(""))).otherwise(cut).alias("blocks"))
    blocks = texts.select("row", "key", "sha", F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("i", "block"))
    first = F.col("i") == 0
    blocks = blocks.select("row", F.when(first, F.col("key")).alias("key"), F.when(first, F.col("sha")).alias("sha"), "n", F.col("i").cast("long").alias("i"), F.xxhash64("block").alias("lead"), "block")
    level = named(blocks, ["lead"], ["block"], ["row", "key", "sha", "n", "i"], ["row"])
    rounds, done = 0, []
    while True:
        done.append(level.where("n = 1").select("row", "key", "sha", F.lit(rounds).alias("rounds"), "name"))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        even = F.col("i") % 2 == 0
        pairs = rest.groupBy("row", F.floor(F.col("i") / 2).cast("long").alias("j")).agg(
            F.max("key").alias("key"), F.max("sha").alias("sha"), F.floor((F.max("n") + 1) / 2).cast("long").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"),
        ).withColumnRenamed("j", "i")
        level = named(pairs, ["a", "b"], ["a", "b"], ["row", "key", "sha", "n", "i"], ["row"])
        rounds += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _copies(rows: DataFrame) -> DataFrame:
    """rounds, name, best (the row that stays) and group_size of the texts that two rows or more have."""
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    groups = rows.groupBy("rounds", "name").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    return written(groups, "copies")  # its join below then has no aggregation beside it, so that Spark can split a large group


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each input row: key, keep_id, group_size, kept, text_sha256."""
    rows = written(identities(docs, text, key), "identities", release=True)
    joined = rows.join(_copies(rows), ["rounds", "name"], "left")
    alone = F.col("best").isNull()
    return joined.select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("best.key")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows whose text another row has that stays."""
    whole, row = numbered(docs)
    rows = written(identities(whole, text, key, row), "identities", release=True)
    gone = rows.join(_copies(rows), ["rounds", "name"]).where(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_sql(table: str = "documents") -> str:
    return rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM {table})
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t"""
