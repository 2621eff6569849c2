"""Documents and their chunks: change detection, upsert, delete and replacement as joins, and a library on disk.

Defined results: of incoming rows that repeat a path the one with the greatest hash counts. Null paths
are left aside. An empty side leaves the other as it is.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.operators.buckets import BUCKETS, Buckets, removed, there

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/docloom"


def content_hash(column) -> F.Column:
    return F.sha2(column, 256)


def _held(df: DataFrame) -> DataFrame:
    """df cut from its plan in the shared folder of spark.checkpoint.dir; a local one is set only on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
    return df.checkpoint()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for working tables under spark.checkpoint.dir, removed when the driver ends; a local one only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_CHECKPOINTS
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_dropped, spark, path)
    return path


def _dropped(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            pass


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with 1, 2, ... in the order of a column, from ranges of it and their counts: no task sees all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, column).sortWithinPartitions(column)
    ordered = _held(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each range
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def changes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """source_path and status of incoming (source_path, content_hash): new, changed or skipped_unchanged."""
    old = stored.select("source_path", F.col("content_hash").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "skipped_unchanged").otherwise("changed")
    return incoming.join(old, "source_path", "left").select("source_path", status.alias("status"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored (id, source_path, content_hash) with incoming's rows put in; known paths keep their id, new ones follow in the order of paths."""
    latest = incoming.where("source_path IS NOT NULL").groupBy("source_path").agg(F.max("content_hash").alias("content_hash"))
    both = stored.alias("s").join(latest.alias("i"), "source_path", "full")
    merged = both.select("source_path", F.col("s.id").cast("long").alias("id"), F.coalesce("i.content_hash", "s.content_hash").alias("content_hash"))
    known, new = merged.where("id IS NOT NULL"), merged.where("id IS NULL").select("source_path", "content_hash")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))
    fresh = numbered(new, "source_path", "n").crossJoin(F.broadcast(top)).select("source_path", (F.col("top") + F.col("n")).cast("long").alias("id"), "content_hash")
    return known.unionByName(fresh)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key is in gone."""
    return table.join(gone.select(key), key, "left_anti")


def cascade(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (id, source_path) without the paths in gone, and chunks (document_id) without those of such documents."""
    ids = documents.join(gone.select("source_path").distinct(), "source_path", "left_semi").select(F.col("id").alias("document_id"))
    return delete(documents, gone, "source_path"), delete(chunks, ids, "document_id")


def replace_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored chunks, where those of every document in incoming (document_id, ...) are the incoming ones; other documents keep theirs."""
    return delete(stored, incoming.select("document_id").distinct(), "document_id").unionByName(incoming)


DOCUMENTS = """id bigint, source_path string, doc_type string, content_hash string, pages_total int, pages_processed int, pages_needing_ocr int, pages_ocr_recovered int,
tables_found int, chars_recovered bigint, extraction_failures array<string>, ingested_at timestamp, updated_at timestamp, version bigint, deleted boolean"""
CHUNKS = """id bigint, document_id bigint, chunk_index bigint, strategy string, text string, page int, section_path array<string>, char_start bigint, char_end bigint,
from_table boolean, embedding array<float>, version bigint"""


#: Schema, key and order within a bucket of the library's tables.
TABLES = {"documents": (DOCUMENTS, "id", ["id", "version"]), "chunks": (CHUNKS, "document_id", ["document_id", "chunk_index"])}


class Library:
    """Documents and chunks under one path, both dealt into buckets by the document's id; for one writer at a time.

    A document's rows are versions; the latest counts, unless it says deleted. Chunks count if their
    document's latest version is theirs, so writing the documents, which comes last, publishes both.
    compact() leaves the rows that count and, of deleted documents, one row, so that no id is given again.
    A library in the layout of before, two plain Parquet tables, is taken over when it is opened.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        old = {name: f"{self.path}/{name}" for name in TABLES}
        plain = all(there(spark, where) for where in old.values())
        self.store = Buckets(spark, self.path, TABLES, buckets)
        if plain and self.store.generation == 1:
            self.store.compact({name: spark.read.schema(TABLES[name][0]).parquet(where) for name, where in old.items()})

    def _rows(self, name: str, whole: bool = True) -> DataFrame:
        return self.store.rows(name, whole)

    def _latest(self) -> DataFrame:
        """The last version of each document, deleted ones too; grouped within buckets."""
        rows = self._rows("documents")
        row = F.struct(*[c for c in rows.columns if c != "id"])
        return rows.groupBy("id").agg(F.max_by(row, "version").alias("r")).select("id", "r.*")

    def _current(self) -> DataFrame:
        return self._latest().where("NOT deleted")

    def documents(self) -> DataFrame:
        return self._current().drop("version", "deleted")

    def document(self, document_id: int) -> DataFrame:
        """The document of an id, from its bucket alone; no row where there is none."""
        return self.documents().where(F.col("id") == document_id)

    def _live(self, whole: bool = True) -> DataFrame:
        owners = self._current().select(F.col("id").alias("document_id"), F.col("version").alias("_of"), F.col("source_path").alias("source_document"))
        # no equality of versions in the join: they would count as keys, and the buckets are of the id alone
        return self._rows("chunks", whole).join(owners, "document_id").where(F.col("version").between(F.col("_of"), F.col("_of"))).drop("_of")

    def chunks(self, whole: bool = True) -> DataFrame:
        """The chunks that count, joined bucket by bucket; whole=False for a join that Spark may split, where one document holds a large part of all chunks."""
        return self._live(whole).drop("version")

    def count_chunks(self, document_id: int | None = None) -> int:
        rows = self.chunks()
        return (rows if document_id is None else rows.where(F.col("document_id") == document_id)).count()

    def compact(self, buckets: int | None = None) -> None:
        """Drops the rows of old versions and of runs that broke off, and may deal the rest into another number of buckets."""
        self.store.reopen()
        self.store.compact({"documents": self._latest(), "chunks": self._live().drop("source_document")}, buckets)

    def _next_version(self) -> int:
        """One that no row has, chunks of a run that broke off before its documents included."""
        return max(self._rows(name).agg(F.max("version")).first()[0] or 0 for name in ("documents", "chunks")) + 1

    def delete(self, source_path: str) -> bool:
        """Whether there was such a document; its chunks go with it."""
        self.store.reopen()
        found = self._current().where(F.col("source_path") == source_path)
        if found.isEmpty():
            return False
        gone = _held(found.withColumn("version", F.lit(self._next_version()).cast("long")).withColumn("deleted", F.lit(True)))
        self._append(gone, "documents")
        return True

    def _append(self, rows: DataFrame, name: str) -> None:
        self.store.append(name, rows)

    def put(self, chunks: DataFrame, documents: DataFrame, version: int | None = None) -> None:
        """Appends rows made elsewhere as one version, in place of what such documents had: chunks (document_id, ...) and documents (id, source_path, ...); columns that they lack are null."""
        version = self._next_version() if version is None else version
        for name, rows in (("chunks", chunks), ("documents", documents)):
            fixed = {"version": F.lit(version).cast("long")} | ({"deleted": F.lit(False)} if name == "documents" else {})
            lacking = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(TABLES[name][0]) if f.name not in rows.columns}
            self._append(rows.withColumns(lacking | fixed), name)

    def ingest(self, files: DataFrame, embedder, ocr=None) -> DataFrame:
        """Takes files (source_path, content) in: source_path, status (indexed, skipped_unchanged or failed), document_id, chunks_indexed and reason.

        Unchanged files cost a hash; a changed one replaces only its own chunks; one that fails leaves what
        is stored as it is. Of rows that repeat a path the one with the greatest hash counts.
        """
        from docloom.operators.chunking import chunk_documents
        from docloom.operators.extraction import blocks_of, extract
        from docloom.operators.models import embedded

        self.store.reopen()
        version = self._next_version()
        files = files.groupBy("source_path").agg(F.max_by("content", F.coalesce(content_hash(F.col("content")), F.lit(""))).alias("content"))
        hashed = _held(files.select("source_path", content_hash(F.col("content")).alias("content_hash")))
        known = _held(self._current().select("source_path", "id", F.col("content_hash").alias("old"), F.col("ingested_at").alias("since")))
        state = hashed.join(known, "source_path", "left")
        skipped = state.where("old = content_hash").select("source_path")
        work = _held(extract(files.join(skipped, "source_path", "left_anti"), ocr=ocr))
        good = work.where(F.size("blocks") > 0)
        new = numbered(good.join(known, "source_path", "left_anti").select("source_path"), "source_path", "n")
        top = self._rows("documents").agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        ids = known.select("source_path", "id", "since").unionByName(new.crossJoin(F.broadcast(top)).select("source_path", (F.col("top") + F.col("n")).alias("id"), F.lit(None).cast("timestamp").alias("since")))
        ids = _held(ids)
        chunks = chunk_documents(blocks_of(good))
        chunks = embedded(chunks.join(ids.select(F.col("source_path").alias("doc"), F.col("id").alias("document_id")), "doc"), "text", embedder)
        base = self._rows("chunks").agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
        chunks = numbered(chunks.withColumn("_order", F.struct("document_id", "chunk_index")), "_order", "n").crossJoin(F.broadcast(base)).withColumn("id", F.col("base") + F.col("n"))
        self._append(chunks.withColumn("version", F.lit(version).cast("long")), "chunks")
        written = self._rows("chunks").where(F.col("version") == version).groupBy("document_id").agg(F.count("*").cast("int").alias("chunks_indexed"))
        now = F.current_timestamp()
        documents = good.join(ids, "source_path").select("id", "source_path", "doc_type", "content_hash", "quality.*", F.coalesce("since", now).alias("ingested_at"), now.alias("updated_at"), F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"))
        self._append(documents, "documents")
        done = good.join(ids, "source_path").select("source_path", F.col("id").alias("document_id")).join(written, "document_id", "left")
        report = done.select("source_path", F.lit("indexed").alias("status"), "document_id", F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"), F.lit(None).cast("string").alias("reason"))
        nothing = [F.lit(None).cast("long").alias("document_id"), F.lit(0).alias("chunks_indexed")]
        failures = F.array_join("quality.extraction_failures", ", ")
        failed = work.where(F.size("blocks") == 0).select("source_path", F.lit("failed").alias("status"), *nothing, F.when(F.col("content_hash").isNull(), failures).otherwise(F.concat(F.lit("extraction_failed: "), failures)).alias("reason"))
        same = skipped.select("source_path", F.lit("skipped_unchanged").alias("status"), *nothing, F.lit(None).cast("string").alias("reason"))
        return report.unionByName(failed).unionByName(same)
