"""Tables dealt into buckets by a key, so that joins and lookups by it need no shuffle, and their generations.

A Buckets is a folder with some tables of rows in versions. Rows are only appended; compact() writes what
still counts as the next generation and publishes it with one row, so that a run that breaks off leaves the
generation before as it was. Bucket counts may change from one generation to the next.

Spark's bucketed tables need a name in the session's catalog; it is derived from the folder, and the table is
external: dropping the name leaves the rows. In a catalog that outlives the session such names stay there.

Defined results: a key that is null is kept and lies in a bucket of its own hash. Tables without rows read
as empty. A bucket is read by one task: rows(name, whole=False) reads them undealt, for joins in which one
key holds a large part of all rows and which Spark should split.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
GENERATIONS = "generation int, buckets int"


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018 - looks whether it is there
    except Exception as wrong:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(wrong) and "UNABLE_TO_INFER_SCHEMA" not in str(wrong):
            raise
        return False
    return True


class Buckets:
    """tables: name to (schema as DDL, key column, columns that rows of a bucket are sorted by). For one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str, list[str]]], buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError("there must be a bucket at least")
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.generation, self.buckets = 0, buckets
        self.reopen()

    def reopen(self) -> None:
        """Takes up the newest generation, which another writer may have published; begins the first one in a folder without any."""
        if not there(self.spark, f"{self.path}/generations"):
            self._publish(1, self.buckets)
        newest = self._generations().agg(F.max(F.struct("generation", "buckets")).alias("g")).first()["g"]
        self.generation, self.buckets = newest["generation"], newest["buckets"]

    def _generations(self) -> DataFrame:
        return self.spark.read.schema(GENERATIONS).parquet(f"{self.path}/generations")

    def _publish(self, generation: int, buckets: int) -> None:
        row = self.spark.range(1).select(F.lit(generation).cast("int").alias("generation"), F.lit(buckets).cast("int").alias("buckets"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _folder(self, name: str, generation: int) -> str:
        return f"{self.path}/generation-{generation}/{name}"

    def _table(self, name: str, generation: int, buckets: int) -> str:
        """The name of a table in the catalog, where it is put if it is not there yet."""
        schema, key, order = self.tables[name]
        folder = self._folder(name, generation)
        known = f"spark_catalog.default.docloom_{name}_{hashlib.sha256(f'{folder} {buckets}'.encode()).hexdigest()[:16]}"
        place = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({', '.join(f'`{c}`' for c in order)}) INTO {buckets} BUCKETS LOCATION '{place}'")
        return known

    def rows(self, name: str, whole: bool = True) -> DataFrame:
        """All rows of a table, whatever their version. whole: dealt into buckets, of which each is read by one task."""
        table = self._table(name, self.generation, self.buckets)
        self.spark.catalog.refreshTable(table)  # files that another session appended
        rows = self.spark.table(table)
        if whole or not there(self.spark, self._folder(name, self.generation)):
            return rows
        return self.spark.read.schema(rows.schema).parquet(self._folder(name, self.generation))

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, self.generation, self.buckets, False)

    def _write(self, name: str, rows: DataFrame, generation: int, buckets: int, anew: bool) -> None:
        schema, key, _ = self.tables[name]
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
        # dealt as the table is, so that a task writes one file for each of its buckets
        rows.repartition(buckets, F.col(f"`{key}`")).write.insertInto(self._table(name, generation, buckets), overwrite=anew)

    def compact(self, kept: dict[str, DataFrame], buckets: int | None = None) -> None:
        """Writes the kept rows as the next generation and publishes it; the one before stays until the next time, for readers under way."""
        generation, buckets = self.generation + 1, buckets or self.buckets
        if buckets < 1:
            raise ValueError("there must be a bucket at least")
        for name in self.tables:
            self._write(name, kept[name], generation, buckets, True)
        self._publish(generation, buckets)
        old = self._generations().where(F.col("generation") < self.generation).select("generation", "buckets").distinct().collect()  # a row for each compaction
        for row in old:
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, row['generation'], row['buckets'])}")
            removed(self.spark, f"{self.path}/generation-{row['generation']}")
        self.generation, self.buckets = generation, buckets
