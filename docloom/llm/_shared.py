"""Working tables in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_DEFAULT = "file:///tmp/checkpoints/docloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; sets LOCAL_DEFAULT where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            pass


def written(df: DataFrame, label: str, release: bool = False, path: str | None = None) -> DataFrame:
    """df written once to the shared folder and read back: later jobs start from the files.

    release: has the driver look for what is no longer used, so that executors let go of the shuffle
    files of this job and those before, which else stay until the driver happens to collect garbage.
    path: a new_folder() of the caller's, who can remove it when the table is of no more use.
    """
    path = path or new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted(examples: DataFrame, order: list[str], fit: Callable[[pa.Table], list[np.ndarray]]) -> list[np.ndarray]:
    """What fit makes of the examples, sorted by order, in one task; the driver gets the arrays that it returns alone.

    examples must be bounded in number, and each in size. They are written first, so that the task can
    be run again without making them anew.
    """
    examples = written(examples, "examples")
    schema = examples.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fit(pa.Table.from_batches(list(batches), schema))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([str(a.dtype) for a in made]), pa.array([list(a.shape) for a in made], pa.list_(pa.int64())), pa.array([a.tobytes() for a in made], pa.binary())], ["i", "dtype", "shape", "a"])

    rows = examples.coalesce(1).sortWithinPartitions(*order).mapInArrow(run, "i int, dtype string, shape array<long>, a binary").collect()
    if not rows:
        return fit(schema.empty_table())
    return [np.frombuffer(r["a"], r["dtype"]).reshape(r["shape"]) for r in sorted(rows, key=lambda r: r["i"])]


#: Bits of a filter: at least, for each value, and at most (as 8 MB go to every executor; a fuller filter lets more through).
FILTER_LEAST, FILTER_PER_VALUE, FILTER_MOST = 1 << 16, 12, 1 << 26


def bit_filter(values: DataFrame, column: str) -> bytes:
    """A filter over a long column for passes(), sized by its count; it only spares rows a shuffle and never decides a result."""
    values = written(values.select(F.col(column).alias("v")).distinct(), "filter")
    bits, most = FILTER_LEAST, FILTER_PER_VALUE * values.count()
    while bits < min(most, FILTER_MOST):
        bits *= 2
    place = values.select(F.expr(f"v & {bits - 1}L").alias("p"))
    words = place.groupBy(F.expr("cast(shiftright(p, 6) as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return table.tobytes()


def passes(table: bytes, values: np.ndarray) -> np.ndarray:
    """Which values the filter lets through: all of those it was made of."""
    words = np.frombuffer(table, np.uint64)
    p = values.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def unused(df: DataFrame, name: str) -> str:
    """name, or what it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to the shared folder, with a number for each row that every later reading gives it again; and that column's name."""
    row = unused(df, "row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds what a task holds of long texts: at most `rows` at once, in Parquet's readers and in Python workers."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > rows:
            spark.conf.set(key, str(rows))


def map_texts(df: DataFrame, text: str, kept: list[str], fn: Callable[[pa.Array], pa.Array], ddl: str) -> DataFrame:
    """The kept columns of df, then those of fn(texts), a struct array of type ddl; names may clash.

    Rows pass through as Arrow batches: unlike with a UDF, no queue of rows holds the texts meanwhile.
    """
    made = T.StructType.fromDDL(ddl)
    inner = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([T.StructField(f"k{i}", inner.schema[i].dataType) for i in range(len(kept))] + [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.column("t"))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *out.flatten()], schema.names)

    small_batches(df.sparkSession)
    return inner.mapInArrow(run, schema).toDF(*kept, *made.names)
